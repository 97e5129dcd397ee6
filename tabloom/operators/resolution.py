"""Manifests over records: units in dependency order, values with lineage, missing-value policy, bindings."""

from __future__ import annotations

from dataclasses import dataclass, field
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabloom.functions import scores
from tabloom.functions.text import normalise_label, null_if_missing_word, slug
from tabloom.operators import conditions, formulas
from tabloom.operators.joins import shared_path, small


@dataclass
class Unit:
    """kind: source (value = column), static (value = text), computed (value = formula), conditional (value = condition), human."""

    id: str
    kind: str
    value: str = ""
    on_missing: str = "BLOCK"
    default: str | None = None
    needs: list[str] = field(default_factory=list)


def order(units: list[Unit]) -> list[Unit]:
    """Units after all that they need."""
    by = {u.id: u for u in units}
    graph = {}
    for u in units:
        reads = formulas.identifiers(u.value) if u.kind == "computed" else conditions.inputs(u.value) if u.kind == "conditional" else []
        graph[u.id] = {n for n in [*u.needs, *reads] if n in by and n != u.id}
    try:
        return [by[i] for i in TopologicalSorter(graph).static_order()]
    except CycleError as e:
        raise ValueError(f"units depend on each other: {e.args[1]}") from e


def on_missing(value: Column, policy: str, default: str | None) -> tuple[Column, Column]:
    """Value and status under BLOCK, BLANK, DEFAULT or REMOVE_SENTENCE."""
    there = value.isNotNull()
    if policy == "DEFAULT":
        return F.coalesce(value, F.lit(default)), F.when(there, "resolved").otherwise("defaulted")
    if policy == "BLANK":
        return F.coalesce(value, F.lit("")), F.when(there, "resolved").otherwise("blank")
    if policy == "REMOVE_SENTENCE":
        return value, F.when(there, "resolved").otherwise("sentence_removed")
    return value, F.when(there, "resolved").otherwise("blocked")


def resolve(records: DataFrame, units: list[Unit]) -> DataFrame:
    """Records with a column per unit, `lineage` (unit, kind, value, source, status) and `blocked`. Each unit is a column over
    the ones before it, so the optimizer sees one projection."""
    # The record is kept whole beside the units, so a unit may have the name of a column that it reads.
    columns = {c: F.col("_record").getField(c) for c in records.columns}
    out, lineage = records.withColumn("_record", F.struct(*[F.col(f"`{c}`") for c in records.columns])), []
    for u in order(units):
        fields = dict(columns)
        if u.kind == "static":
            raw = F.lit(u.value)
        elif u.kind == "source":
            raw = null_if_missing_word(fields[u.value].cast("string")) if u.value in fields else F.lit(None).cast("string")
        elif u.kind == "computed":
            raw = formulas.formula(u.value, fields)["value"].cast("string")
        elif u.kind == "conditional":
            raw = conditions.verdict(u.value, fields)
            raw = F.when(raw != "UNDECIDED", raw)
        else:
            raw = F.lit(None).cast("string")
        value, status = on_missing(raw, u.on_missing if u.kind != "human" else "BLOCK", u.default)
        if u.kind == "human":
            status = F.lit("needs_human")
        out = out.withColumn(u.id, value).withColumn(f"_s_{u.id}", status)
        columns[u.id] = F.col(u.id)
        lineage.append(F.struct(F.lit(u.id).alias("unit"), F.lit(u.kind).alias("kind"), F.col(u.id).cast("string").alias("value"), F.lit(u.value).alias("source"), F.col(f"_s_{u.id}").alias("status")))
    out = out.withColumn("lineage", F.array(*lineage)).withColumn("blocked", F.exists("lineage", lambda x: x["status"].isin("blocked", "needs_human")))
    return out.drop("_record", *[f"_s_{u.id}" for u in units])


def apply_binding(records: DataFrame, bindings: dict[str, str], value_map: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """Columns renamed to fields; values mapped exactly, then without case."""
    cols = []
    for f, c in bindings.items():
        value = F.col(c).cast("string")
        mapping = (value_map or {}).get(f)
        if mapping:
            exact = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
            folded = F.create_map(*[F.lit(x) for kv in {k.strip().lower(): v for k, v in mapping.items()}.items() for x in kv])
            value = F.coalesce(F.element_at(exact, value), F.element_at(folded, F.lower(F.trim(value))), value)
        cols.append(value.alias(f))
    return records.select(*cols)


def unmatched_values(records: DataFrame, column: str, offered: list[str]) -> DataFrame:
    """Distinct values that no branch names."""
    return records.select(F.col(column).alias("value")).where(F.col("value").isNotNull()).distinct().where(~normalise_label(F.col("value")).isin(*[" ".join(o.split()).lower() for o in offered]))


def suggest(targets: DataFrame, columns: DataFrame, memory: DataFrame | None = None, least: float = 0.62) -> DataFrame:
    """Ranked pairs of target (target, declared_type, material) and column (column, observed_type): name, similarity, precedent and
    type as evidence; score, band, vetoes. Both sides describe schemas, so they are small and one side is broadcast."""
    from tabloom.functions.text import fuzzy_ratio

    p = targets.join(small(columns, 100_000), F.lit(True))
    p = p.withColumn("exact", slug(F.col("target")) == slug(F.col("column"))).withColumn("similarity", fuzzy_ratio(slug(F.col("target")), slug(F.col("column"))))
    if memory is not None:
        p = p.join(small(memory.select("target", "column", "approvals")), ["target", "column"], "left")
    else:
        p = p.withColumn("approvals", F.lit(0))
    sig = lambda s, w: F.struct(s.cast("double").alias("s"), F.lit(w).alias("w"))
    kind = scores.compare_types(F.col("declared_type"), F.col("observed_type"))
    p = p.withColumn("type_match", kind).where(F.col("exact") | (F.col("similarity") >= least) | (F.coalesce("approvals", F.lit(0)) > 0))
    signals = F.array(sig(F.col("exact"), 0.9), sig(F.col("similarity"), 0.6), sig(scores.saturating(F.coalesce("approvals", F.lit(0))), 0.7), sig(F.when(F.col("type_match") == "COMPATIBLE", 1.0).otherwise(0.0), 0.2))
    p = p.withColumn("score", scores.noisy_or(signals))
    top = W.partitionBy("target").orderBy(F.desc("score"), "column")
    every = W.partitionBy("target")
    p = p.withColumn("best", F.max("score").over(every)).withColumn("rank", F.row_number().over(top)).withColumn("near", (F.col("score") >= F.col("best") - scores.TIE_MARGIN).cast("int")).withColumn("tied", F.sum("near").over(every) > 1).drop("near")
    vetoes = F.array_compact(F.array(F.when(F.col("type_match") == "MISMATCH", "type_mismatch"), F.when((F.col("rank") == 1) & F.col("tied"), "ambiguous"), F.when(F.coalesce("approvals", F.lit(0)) == 0, "no_precedent")))
    p = p.withColumn("vetoes", vetoes)
    return p.withColumn("band", scores.band(F.col("score"), F.size("vetoes") > 0, F.coalesce("material", F.lit(False)))).drop("best")


def assign(suggestions: DataFrame, group: str | None = None) -> DataFrame:
    """One column for each target and one target for each column: targets choose in the order of their best score (ties by
    name), each the best column that is left.

    Every column prefers the earlier target, so this order of choices is what deferred acceptance ends in: in each round all targets
    ask for the best column they have not lost, and a column's pairs with later targets than the earliest that asks are
    dropped. A round is two aggregations and two joins over what is left; it ends when no column is asked for twice. Targets whose columns
    are all lost get none; a pair given twice counts once, with its better score; null scores are no suggestion."""
    spark, key = suggestions.sparkSession, ([group] if group else [])
    s = suggestions.where(F.col("score").isNotNull() & F.col("target").isNotNull() & F.col("column").isNotNull())
    pairs = s.groupBy(*key, "target", "column").agg(F.max("score").alias("score"), F.max_by("band", "score").alias("band"))
    turn = F.struct((-F.col("leader")).alias("leader"), "target")
    leaders = pairs.groupBy(*key, "target").agg(F.max("score").alias("leader"))
    pairs = pairs.join(leaders, [*key, "target"]).withColumn("turn", turn).drop("leader")
    path, n = shared_path(spark, "assignment"), 0
    while True:
        pairs.write.parquet(f"{path}/{n}")
        pairs = spark.read.parquet(f"{path}/{n}")
        asked = pairs.groupBy(*key, "target").agg(F.min(F.struct((-F.col("score")).alias("rank"), "column")).alias("first"), F.min("turn").alias("turn"))
        asked = asked.select(*key, "target", F.col("first.column").alias("column"), "turn")
        held = asked.groupBy(*key, "column").agg(F.min("turn").alias("earliest"), F.count("*").alias("asking"))
        if not held.where("asking > 1").limit(1).count():
            return pairs.join(asked.drop("turn"), [*key, "target", "column"], "left_semi").select(*key, "target", "column", "score", "band")
        pairs = pairs.join(held.drop("asking"), [*key, "column"], "left").where(F.col("earliest").isNull() | (F.col("turn") <= F.col("earliest"))).drop("earliest")
        n += 1


def mapping_memory(log: DataFrame) -> DataFrame:
    """Approvals and rejections of each mapping from an append-only log of (target, column, event)."""
    return log.groupBy("target", "column").agg(F.count_if(F.col("event") == "approved").alias("approvals"), F.count_if(F.col("event") == "rejected").alias("rejections")).withColumn("net", F.col("approvals") - F.col("rejections"))


def reviewer_decision(suggested: Column, final: Column) -> Column:
    return F.when(final.isNull(), "rejected").when(suggested.eqNullSafe(final), "accepted").otherwise("edited")


#: Weights of a remembered mapping's similarity and approvals, what a rejection costs, the least similarity.
SIMILARITY, APPROVALS, REJECTION, LEAST_SIMILARITY = 0.6, 0.4, 0.25, 0.25


def memory_lookup(entries: DataFrame, org: str, k: int = 5, org_col: str = "org_id") -> DataFrame:
    """The k best remembered mappings of one tenant for each target: entries have similarity (of the contexts), approvals and
    rejections. Entries rejected as often as approved, or of another context, are no suggestion. Ties by net approvals and name."""
    from tabloom.operators.usage import tenant_scope

    e = tenant_scope(entries, org, org_col).withColumn("net", F.col("approvals") - F.col("rejections"))
    e = e.where((F.col("net") > 0) & (F.col("similarity") >= LEAST_SIMILARITY))
    score = SIMILARITY * F.col("similarity") + APPROVALS * scores.saturating(F.col("net")) - REJECTION * F.col("rejections")
    order = W.partitionBy("target").orderBy(F.desc("score"), F.desc("net"), "column")
    return e.withColumn("score", score).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).withColumn("score", F.bround("score", 4))


def bindable_targets(manifest: dict) -> list[tuple[str, str]]:
    """(name, origin) of all that has to be bound: fields, then inputs of conditions, then inputs of computed fields."""
    out: dict[str, str] = {}
    for f in manifest.get("fields", []):
        out[f["id"]] = "formula" if f.get("kind") == "computed" else "field"
    for c in manifest.get("conditions", []):
        for name in conditions.inputs(c["expression"]):
            out.setdefault(name, "condition")
    for f in manifest.get("fields", []):
        for name in f.get("inputs") or ([] if f.get("kind") != "computed" or "expression" not in f else formulas.identifiers(f["expression"])):
            out.setdefault(name, "formula")
    return list(out.items())


#: Confidence of the tiers of suggestion, the surest first.
TIERS = (("mergefield", 1.0), ("dictionary", 0.95), ("name", 0.9), ("similar", 0.75), ("model", 0.6))


def tiered(targets: DataFrame, columns: DataFrame, dictionary: DataFrame, matcher=None, least_cosine: float | None = None) -> DataFrame:
    """The surest tier of each target: a column named like its merge field, one that the dictionary (target, column) names, or one
    of the same slug; then, with least_cosine, the column whose name's features are most like the target's (ties by name), and its cosine as
    confidence; else what a matcher says, a function of targets and columns to pairs (target, column). target, column, tier,
    confidence; targets that no tier knows are left out."""
    c = small(columns.select("column", slug(F.col("column")).alias("_s")), 100_000)
    t = targets.select("target", "mergefield")
    as_tier = lambda df, n: df.select("target", "column", F.lit(n).alias("_t"), F.lit(TIERS[n][1]).alias("_c"))
    code = as_tier(t.join(c, slug(F.col("mergefield")) == F.col("_s")), 0)
    known = as_tier(t.join(small(dictionary.select("target", slug(F.col("column")).alias("_d"))), "target").join(c, F.col("_d") == F.col("_s")), 1)
    same = as_tier(t.join(c, slug(F.col("target")) == F.col("_s")), 2)
    every = code.unionByName(known).unionByName(same)
    if least_cosine is not None:
        every = every.unionByName(name_cosines(t.join(every.select("target").distinct(), "target", "left_anti"), columns, least_cosine).withColumn("_t", F.lit(3)).withColumnRenamed("cosine", "_c"))
    if matcher is not None:
        every = every.unionByName(as_tier(matcher(targets, columns).join(columns.select("column").distinct(), "column", "left_semi"), 4))
    best = every.groupBy("target").agg(F.min(F.struct("_t", (-F.col("_c")).alias("c"), "column")).alias("b"))
    names = F.array(*[F.lit(n) for n, _ in TIERS])
    return best.select("target", F.col("b.column").alias("column"), F.get(names, F.col("b._t")).alias("tier"), (-F.col("b.c")).alias("confidence"))


def name_cosines(targets: DataFrame, columns: DataFrame, least: float) -> DataFrame:
    """target, column, cosine of the names whose hashed features are alike. Only names that share three letters in a row meet."""
    from tabloom.operators.retrieval import embedder

    embed = embedder()
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(slug(c)) - 2)), lambda i: F.substring(slug(c), i, 3)))
    side = lambda df, c: df.select(c).where(F.col(c).isNotNull()).distinct()
    a, b = side(targets, "target"), side(columns, "column")
    met = a.select("target", F.explode(grams(F.col("target"))).alias("g")).join(b.select("column", F.explode(grams(F.col("column"))).alias("g")), "g").select("target", "column").distinct()
    found = met.join(a.withColumn("_u", embed(F.col("target"))), "target").join(b.withColumn("_v", embed(F.col("column"))), "column")
    return found.select("target", "column", scores.cosine(F.col("_u"), F.col("_v")).alias("cosine")).where(F.col("cosine") >= least)


def material_vetoes(signals: Column, material: Column, type_match: Column, least: int = 2) -> Column:
    """Vetoes of one candidate from array<struct<name, s>>: a type that does not fit, a material field with fewer than `least`
    supporting signals, and no precedent or family behind it."""
    support = F.filter(signals, lambda x: x["s"] > 0)
    precedent = F.exists(support, lambda x: x["name"].isin("historical_approvals", "family_inheritance"))
    return F.array_compact(F.array(F.when(type_match == "MISMATCH", "type_mismatch"), F.when(F.coalesce(material, F.lit(False)) & (F.size(support) < least), "thin_evidence"), F.when(~precedent, "no_precedent")))


def resolve_hooked(records: DataFrame, units: list, narrative=None) -> DataFrame:
    """resolve, then human and narrative units filled by a hook (a function of a record's columns to a column) where one is
    given. Without a hook such units stay null and need a person."""
    out = resolve(records, units)
    if narrative is None:
        return out
    for u in units:
        if u.kind == "human":
            out = out.withColumn(u.id, F.coalesce(F.col(u.id), narrative(u.id)))
    return out
