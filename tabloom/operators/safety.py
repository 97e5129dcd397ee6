"""Safety cases: windows, cross-tabulation, screening, expectedness, duplicates, coding.

Cases have case_id, org_id, product, initial_receipt_date, latest_receipt_date, is_serious; events have event_id, case_id, term
columns, expectedness, confirmed_by, is_serious and two causality answers."""

from __future__ import annotations

import json
from dataclasses import dataclass
from datetime import date
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabloom.functions.scores import disproportionality

#: Weights of agreeing fields, the least score and number of fields of a candidate pair.
WEIGHTS = {
    "worldwide_case_id": 1.0, "local_case_id": 0.7, "onset_date": 0.35, "receipt_date": 0.2, "preferred_terms": 0.3, "country": 0.1,
    "patient_sex": 0.1, "patient_age": 0.2, "reporter_qualification": 0.05, "suspect_drug": 0.1,
}
LEAST_SCORE, LEAST_FIELDS, AGE_YEARS = 0.6, 2, 1.0
RELATED = ("related", "certain", "probable", "probably related", "possible", "possibly related", "likely", "yes")
#: Allowed moves of a signal.
TRANSITIONS = (("candidate", "new"), ("candidate", "refuted"), ("new", "ongoing"), ("new", "closed"), ("ongoing", "closed"), ("closed", "ongoing"))


@dataclass(frozen=True)
class Scope:
    org: str
    product: str
    start: date
    end: date
    lock: date
    birth: date | None = None


def receipt() -> Column:
    return F.coalesce("initial_receipt_date", "latest_receipt_date")


def version() -> Column:
    return F.coalesce("latest_receipt_date", "initial_receipt_date")


def own(s: Scope) -> Column:
    return (F.col("org_id") == s.org) & (F.col("product") == s.product)


def locked(s: Scope) -> Column:
    """Known by the data lock point; a case without a date is not."""
    return version().isNotNull() & (version() <= F.lit(s.lock))


def interval(s: Scope) -> Column:
    return own(s) & locked(s) & receipt().between(F.lit(s.start), F.lit(s.end))


def cumulative(s: Scope) -> Column:
    if s.birth is None:
        raise ValueError("the product has no birth date, so there are no cumulative figures")
    return own(s) & locked(s) & (receipt() >= F.lit(s.birth))


def background(s: Scope) -> Column:
    """Other products of the same tenant in the same window."""
    return (F.col("org_id") == s.org) & (F.col("product") != s.product) & locked(s) & receipt().between(F.lit(s.start), F.lit(s.end))


def undated(s: Scope) -> Column:
    return own(s) & receipt().isNull()


def after_lock(s: Scope) -> Column:
    return own(s) & (version() > F.lit(s.lock))


def window_label(s: Scope) -> Column:
    """undated, after_lock, interval, cumulative or outside, asked in this order."""
    out = F.when(receipt().isNull(), "undated").when(version() > F.lit(s.lock), "after_lock").when(receipt().between(F.lit(s.start), F.lit(s.end)), "interval")
    if s.birth is not None:
        out = out.when(receipt() >= F.lit(s.birth), "cumulative")
    return out.otherwise("outside")


def preview(cases: DataFrame, s: Scope) -> DataFrame:
    """All counts of a window in one pass."""
    n = lambda c, name: F.count_if(F.coalesce(c, F.lit(False))).alias(name)
    cum = cumulative(s) if s.birth else F.lit(False)
    return cases.agg(n(own(s), "stored"), n(interval(s), "interval"), n(cum, "cumulative"), n(undated(s), "undated"), n(after_lock(s), "after_lock"), n(interval(s) & F.col("is_serious"), "interval_serious"), n(background(s), "background"))


def is_serious() -> Column:
    """The event's own flag once a person confirmed it, else the event's or the case's."""
    flag = F.coalesce("event_serious", F.lit(False))
    return F.when(F.col("confirmed_by").isNotNull(), flag).otherwise(flag | F.coalesce("is_serious", F.lit(False)))


def expectedness_bucket() -> Column:
    return F.when(F.col("confirmed_by").isNotNull() & F.col("expectedness").isin("listed", "unlisted"), F.col("expectedness")).otherwise("unconfirmed")


def is_related(company: Column, reporter: Column) -> Column:
    """True if either answer says so, false if there are answers and none does, null if nobody answered."""
    answers = F.filter(F.array(F.lower(F.trim(company)), F.lower(F.trim(reporter))), lambda a: a.isNotNull() & (a != ""))
    return F.when(F.size(answers) == 0, None).otherwise(F.exists(answers, lambda a: a.isin(*RELATED)))


def cross_tab(events: DataFrame, cases: DataFrame, windows: dict[str, Column], soc: str = "soc", pt: str = "pt") -> DataFrame:
    """Terms by organ class with counts per window, seriousness and expectedness, and the ids behind them."""
    joined = events.join(cases.select("case_id", "is_serious", *[c.alias(f"w_{n}") for n, c in windows.items()]), "case_id")
    aggs = []
    for w in windows:
        for serious in (True, False):
            for bucket in ("listed", "unlisted", "unconfirmed"):
                hit = F.coalesce(F.col(f"w_{w}"), F.lit(False)) & (is_serious() == serious) & (expectedness_bucket() == bucket)
                aggs.append(F.count_if(hit).alias(f"{w}_{'serious' if serious else 'other'}_{bucket}"))
        aggs.append(F.array_sort(F.collect_set(F.when(F.col(f"w_{w}"), F.col("event_id")))).alias(f"{w}_ids"))
    return joined.groupBy(soc, pt).agg(*aggs).orderBy(F.lower(soc), F.lower(pt), soc, pt)


def term_case_counts(events: DataFrame, cases: DataFrame, term: str) -> DataFrame:
    """Distinct cases by term: a case that reports a term twice counts once."""
    return events.join(cases.select("case_id"), "case_id", "left_semi").where(F.col(term).isNotNull()).groupBy(F.col(term).alias("term")).agg(F.countDistinct("case_id").alias("cases"))


def screen(own_events: DataFrame, background_events: DataFrame, term: str = "term", case: str = "case_id", min_cases: int = 1) -> DataFrame:
    """Disproportionality of each term against the background, flagged ones first."""
    count = lambda d, n: d.where(F.col(term).isNotNull()).groupBy(F.col(term).alias("term")).agg(F.countDistinct(case).alias(n))
    total = lambda d, n: d.where(F.col(term).isNotNull()).agg(F.countDistinct(case).alias(n))
    # The two totals are single rows; they are joined on a constant, which Spark broadcasts.
    totals = total(own_events, "own_total").withColumn("_k", F.lit(1)).join(total(background_events, "background_total").withColumn("_k", F.lit(1)), "_k")
    t = count(own_events, "a").where(F.col("a") >= min_cases).join(count(background_events, "c"), "term", "left").withColumn("c", F.coalesce("c", F.lit(0))).withColumn("_k", F.lit(1))
    t = t.join(F.broadcast(totals), "_k").withColumn("b", F.col("own_total") - F.col("a")).withColumn("d", F.col("background_total") - F.col("c"))
    m = disproportionality(F.col("a"), F.col("b"), F.col("c"), F.col("d"))
    out = t.select("term", "a", "b", "c", "d", *[c.alias(n) for n, c in m.items()]).withColumn("flag", F.col("meets_evans") | F.col("ror_above_one"))
    return out.orderBy(F.desc("flag"), F.desc(F.coalesce("prr", F.lit(0.0))), F.desc("a"), "term")


#: Fields of two cases by how few others share their value: a signature takes the first ones.
SELECTIVE = ("worldwide_case_id", "local_case_id", "onset_date", "receipt_date", "preferred_terms", "patient_age", "suspect_drug", "reporter_qualification", "country", "patient_sex")
#: What pairs have to share before anything else: one of these sets of fields.
BASES = (("country", "patient_sex"), ("worldwide_case_id",), ("local_case_id",))


def signatures(least_score: float, least_fields: int, most: int = 2) -> list[tuple[str, ...]]:
    """Sets of fields such that each pair that shares a base and agrees on enough shares one of them. Of a smallest sufficient set
    the base and its `most` most selective fields are taken, so a block holds little more than the pairs that count."""
    out: dict[tuple[str, ...], None] = {}
    for i, base in enumerate(BASES):
        others = [f for f in SELECTIVE if f not in base and f not in (BASES[1] + BASES[2] if i == 0 else BASES[1] if i == 2 else ())]
        # Scores are rounded to three places.
        need = least_score - sum(WEIGHTS[f] for f in base) - 0.0005 - 1e-9
        enough = lambda s: sum(WEIGHTS[f] for f in s) >= need and len(s) >= least_fields - len(base)  # noqa: B023, E731
        found: list[tuple[str, ...]] = []
        for n in range(len(others) + 1):
            found += [s for s in combinations(others, n) if enough(s) and not any(set(t) <= set(s) for t in found)]
        out |= dict.fromkeys((*base, *s[:most]) for s in found)
    return list(out)


def _blocks(sets: list[tuple[str, ...]]) -> Column:
    """A case's values in each set of fields, as (sig: the set's number, later, blocks: hashes of the values). Lists give a hash for each
    of their values; an age gives one for its own year and one, marked later, for the next."""
    # A little more than the tolerance, so that ages whose difference is rounded down to it are no two steps apart.
    year = F.floor(F.col("age") / (AGE_YEARS * 1.001))
    single = {"worldwide_case_id": F.col("worldwide_case_id"), "country": F.col("country"), "patient_sex": F.col("sex"), "patient_age": year, "reporter_qualification": F.col("qualification"), "receipt_date": F.col("receipt_date")}
    found = []
    for i, fields in enumerate(sets):
        for later in (0, 1) if "patient_age" in fields else (0,):
            values = [single[f] + later if f == "patient_age" else single[f] for f in fields if f in single]
            rows = F.array(F.xxhash64(F.lit(i), *values))
            for f in (LISTS[f] for f in fields if f in LISTS):
                rows = F.flatten(F.transform(rows, lambda h: F.transform(F.col(f), lambda v: F.xxhash64(h, v))))  # noqa: B023
            for v in values:
                rows = F.when(v.isNotNull(), rows)
            found.append(F.struct(F.lit(i).alias("sig"), F.lit(later).alias("later"), rows.alias("blocks")))
    return F.array(*found)


def _keys(c: DataFrame, sets: list[tuple[str, ...]]) -> Column:
    return F.array_distinct(F.flatten(F.filter(F.transform(_blocks(sets), lambda x: x["blocks"]), lambda x: x.isNotNull())))


#: Cases of a block that one task compares with so many others at a time; larger blocks are cut into pairs of such tiles.
TILE = 16_384
#: Fields of a case that are lists.
LISTS = {"local_case_id": "local_ids", "preferred_terms": "terms", "onset_date": "onsets", "suspect_drug": "drugs"}
CASE_FIELDS = ("case_id", "worldwide_case_id", "local_ids", "country", "sex", "age", "qualification", "receipt_date", "terms", "onsets", "drugs")


def duplicate_pairs(cases: DataFrame, least_score: float = LEAST_SCORE, least_fields: int = LEAST_FIELDS) -> DataFrame:
    """Candidate pairs that agree on enough, each pair once. Pairs share country and sex, or an identifier; and since that alone is not
    enough, they meet only by what else they have to share (signatures), never all with all in a country.

    Cases move with their fields, once for each block, and are compared where they meet: pairs are neither shuffled nor kept. Of the
    blocks that a pair shares it counts in that of its first signature, and there in the smallest.

    A case has case_id, worldwide_case_id, local_ids (array), country, sex, age, qualification, receipt_date, terms (array),
    onsets (array), drugs (array). Nulls agree with nothing, in lists too."""
    sets = signatures(least_score, least_fields)
    c = cases.where("case_id is not null").select(*[F.array_distinct(F.array_compact(x)).alias(x) if x in LISTS.values() else x for x in CASE_FIELDS])
    # The other fields are one column, of which a comparison that ends early reads nothing.
    found = c.select("case_id", F.struct(*CASE_FIELDS[1:]).alias("case"), F.inline(_blocks(sets)))
    keys = found.select("case_id", "case", "sig", "later", F.when(F.size("blocks") > 1, F.col("blocks")).alias("many"), F.explode("blocks").alias("block"))
    # Few: a large block has over TILE keys.
    large = keys.groupBy("block").agg(F.count("*").alias("n")).where(F.col("n") > TILE).select("block", F.ceil(F.col("n") / TILE).alias("tiles"))
    dealt = keys.join(F.broadcast(large), "block", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1))).withColumn("tile", F.pmod(F.xxhash64("case_id"), "tiles"))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).withColumn("low", F.least("tile", "with")).withColumn("high", F.greatest("tile", "with")).drop("tiles", "with")
    side = lambda k: dealt.select(*[F.col(x).alias(f"{k}_{x}") for x in dealt.columns])
    L, R = (lambda x: F.col(f"l_{x}")), (lambda x: F.col(f"r_{x}"))
    own, other = (lambda x: L("case")[x]), (lambda x: R("case")[x])
    same = lambda x: own(x) == other(x)
    single = lambda x: (F.size(own(x)) == 1) & (F.size(other(x)) == 1)
    both = lambda x: F.when(single(x), F.get(own(x), F.lit(0)) == F.get(other(x), F.lit(0))).otherwise(F.arrays_overlap(own(x), other(x)))
    checks = {
        "worldwide_case_id": same("worldwide_case_id"), "local_case_id": both("local_ids"), "country": same("country"), "patient_sex": same("sex"),
        "patient_age": F.abs(own("age") - other("age")) <= AGE_YEARS, "reporter_qualification": same("qualification"),
        "receipt_date": same("receipt_date"), "preferred_terms": both("terms"), "onset_date": both("onsets"), "suspect_drug": both("drugs"),
    }
    # What follows from the fields that agree is looked up by their bits.
    bits = reduce(Column.bitwiseOR, [F.when(v, 1 << i).otherwise(0) for i, v in enumerate(checks.values())])
    agreed = [[k for i, k in enumerate(checks) if m >> i & 1] for m in range(1 << len(checks))]
    scores = [round(sum(WEIGHTS[k] for k in x), 3) for x in agreed]
    first = [next((i for i, s in enumerate(sets) if score >= least_score and len(x) >= least_fields and {*s} <= {*x}), -1) for x, score in zip(agreed, scores, strict=True)]
    table = lambda xs, kind: F.get(F.from_json(F.lit(json.dumps(xs)), f"array<{kind}>"), F.col("bits"))
    meet = (L("block") == R("block")) & (L("low") == R("low")) & (L("high") == R("high")) & (L("sig") == R("sig"))
    once = F.when(L("low") == L("high"), L("case_id") < R("case_id")).otherwise((L("tile") == L("low")) & (R("tile") == R("high"))) & ((L("later") == 0) | (R("later") == 0))
    smallest = L("many").isNull() | R("many").isNull() | (L("block") == F.array_min(F.array_intersect(L("many"), R("many"))))
    # Exploded, so that Spark computes the bits once a pair and not anew wherever they are used, in methods too long to be compiled.
    p = side("l").join(side("r"), meet & once).select("l_case_id", "r_case_id", "l_sig", "l_block", "l_many", "r_many", F.explode(F.array(bits)).alias("bits")).where((table(first, "int") == L("sig")) & smallest)
    return p.select(F.least("l_case_id", "r_case_id").alias("a"), F.greatest("l_case_id", "r_case_id").alias("b"), table(scores, "double").alias("score"), table(agreed, "array<string>").alias("matched_on"))


def new_pairs(pairs: DataFrame, stored: DataFrame) -> DataFrame:
    return pairs.join(stored.select("a", "b"), ["a", "b"], "left_anti")


def expectedness(events: DataFrame, terms: DataFrame, pt: str = "pt") -> DataFrame:
    """listed, unlisted, or null with the reason: uncoded events and conditioned listings are for a person."""
    fold = lambda c: F.lower(F.trim(c))
    t = terms.groupBy(fold(F.col("pt")).alias("_t")).agg(F.count_if(F.trim(F.coalesce("condition_text", F.lit(""))) != "").alias("conditions"), F.count("*").alias("entries"))
    e = events.join(t, fold(F.col(pt)) == F.col("_t"), "left")
    uncoded = F.trim(F.coalesce(F.col(pt), F.lit(""))) == ""
    return e.withColumn("suggestion", F.when(uncoded | (F.col("conditions") > 0), None).when(F.col("entries").isNull(), "unlisted").otherwise("listed")).withColumn("basis", F.when(uncoded, "uncoded").when(F.col("entries").isNull(), "no matching term").when(F.col("conditions") > 0, "listed under a condition").otherwise("listed")).drop("_t", "conditions", "entries")


def code_terms(events: DataFrame, dictionary: DataFrame, verbatim: str = "verbatim") -> DataFrame:
    """Hierarchy of a verbatim term, by lowest-level term first, then by preferred term."""
    fold = lambda c: F.lower(F.regexp_replace(F.trim(c), r"\s+", " "))
    d = dictionary.select(fold(F.col("llt")).alias("_l"), fold(F.col("pt")).alias("_p"), F.struct("pt", "soc").alias("h"))
    llt = d.groupBy("_l").agg(F.min("h").alias("hl"))
    pts = d.groupBy("_p").agg(F.min("h").alias("hp"))
    e = events.withColumn("_v", fold(F.col(verbatim)))
    out = e.join(llt, F.col("_v") == F.col("_l"), "left").join(pts, F.col("_v") == F.col("_p"), "left").withColumn("_h", F.coalesce("hl", "hp"))
    return out.withColumn("coded_pt", F.col("_h.pt")).withColumn("coded_soc", F.col("_h.soc")).drop("_v", "_l", "_p", "hl", "hp", "_h")


def check_transitions(moves: DataFrame, before: str = "before", after: str = "after") -> DataFrame:
    """Moves with whether a signal may make them."""
    ok = F.col(before) == F.col(after)
    for a, b in TRANSITIONS:
        ok = ok | ((F.col(before) == a) & (F.col(after) == b))
    return moves.withColumn("allowed", F.coalesce(ok, F.lit(False)))


def upsert_cases(log: DataFrame, fields: list[str], key: str = "case_id", version_col: str = "version") -> DataFrame:
    """Newest version wins; where it is null, the newest value before it stays."""
    w = W.partitionBy(key).orderBy(F.desc(version_col))
    filled = log.select(key, version_col, *[F.first(c, ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing)).alias(c) for c in fields], F.row_number().over(w).alias("_r"))
    return filled.where("_r = 1").drop("_r")


def line_listing(rows: DataFrame, case: str, first: list[str], events: str, order: str) -> DataFrame:
    """Rows of a listing by case: the first filled value of each case field by row order, and all events."""
    return rows.where(F.trim(F.coalesce(F.col(case), F.lit(""))) != "").groupBy(case).agg(*[F.min_by(F.col(c), F.when(F.col(c).isNotNull() & (F.trim(c) != ""), F.col(order))).alias(c) for c in first], F.array_sort(F.collect_list(F.struct(order, events))).alias("events"))


def skipped_rows(rows: DataFrame, case: str) -> DataFrame:
    return rows.where(F.trim(F.coalesce(F.col(case), F.lit(""))) == "").withColumn("reason", F.lit("no case identifier"))


def overlaps_period(start: Column, end: Column, period_start, period_end) -> Column:
    """Open ends run on."""
    return (start <= F.lit(period_end)) & (end.isNull() | (end >= F.lit(period_start)))


def trial_saes(events: DataFrame, cases: DataFrame, cumulative_window: Column, soc: str = "soc", pt: str = "pt") -> DataFrame:
    """Serious events of clinical-trial cases in the cumulative window, by term."""
    c = cases.where((F.col("source") == "clinical_trial") & cumulative_window).select("case_id", "is_serious")
    return events.join(c, "case_id").where(is_serious()).groupBy(soc, pt).agg(F.count("*").alias("events"), F.countDistinct("case_id").alias("cases"))


def serious_unrelated(events: DataFrame, cases: DataFrame, interval_window: Column) -> DataFrame:
    """One row: events of the interval that are serious and that somebody assessed as not related."""
    j = events.join(cases.where(interval_window).select("case_id", "is_serious"), "case_id")
    return j.agg(F.count_if(is_serious() & F.coalesce(~is_related(F.col("company"), F.col("reporter")), F.lit(False))).alias("n"))


def bulk_targets(events: DataFrame, term: str, pt: str = "pt") -> DataFrame:
    """Events whose term is the given one, whatever the case."""
    return events.where(F.lower(F.trim(F.col(pt))) == term.strip().lower())


def rsi_versions(versions: DataFrame, terms: DataFrame) -> DataFrame:
    """Reference versions, the latest first and undated ones last, with how many terms each lists."""
    n = terms.groupBy("version_id").agg(F.count("*").alias("listed"))
    return versions.join(n, "version_id", "left").withColumn("listed", F.coalesce("listed", F.lit(0))).orderBy(F.col("effective").desc_nulls_last(), "version_id")


def report_audit(log: DataFrame, *owners: DataFrame) -> DataFrame:
    """Audit rows of a report: those of any entity that belongs to it. owners: one column of entity ids each."""
    ids = None
    for o in owners:
        one = o.toDF("entity_id")
        ids = one if ids is None else ids.unionByName(one)
    return log.join(ids, "entity_id", "left_semi")
