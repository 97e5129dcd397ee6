"""Scores: evidence, disproportionality, similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
Z_95 = 1.959963984540054
SEMANTIC_FLOOR = 0.75
HISTORY_SCALE = 8.0
REVIEW_FLOOR, CONFIRM_FLOOR, AUTO_FLOOR = 0.50, 0.80, 0.97
TIE_MARGIN = 0.05
MONEY_TYPES = ("currency", "money", "amount")
IDENTIFIER_TYPES = ("identifier", "id", "reference")
TYPE_FAMILY = {
    "text": ("string", "str", "text", "varchar", "char"),
    "number": ("number", "numeric", "int", "integer", "float", "double", "decimal", "percent", "currency", "money", "amount"),
    "date": ("date", "datetime", "timestamp"),
    "boolean": ("bool", "boolean"),
    "identifier": ("identifier", "id", "reference"),
}
ACCEPTS = {"text": ("text", "number", "date", "boolean", "identifier"), "identifier": ("identifier", "text", "number"), "number": ("number",), "date": ("date",), "boolean": ("boolean",)}


def noisy_or(signals: Column) -> Column:
    """1 - product of (1 - strength * weight) over array<struct<s, w>>."""
    return 1 - F.aggregate(signals, F.lit(1.0), lambda a, x: a * (1 - x["s"] * x["w"]))


def saturating(n: Column, scale: float = HISTORY_SCALE) -> Column:
    return 1 - F.exp(-n / scale)


def semantic(cosine: Column) -> Column:
    """A cosine under the floor is no evidence."""
    return F.when(cosine >= SEMANTIC_FLOOR, cosine).otherwise(F.lit(0.0))


def band(score: Column, vetoed: Column, material: Column) -> Column:
    """BLOCK, REVIEW, CONFIRM or AUTO_ACCEPT. A veto forces review; money and identifiers are never accepted unseen."""
    return (
        F.when(score < REVIEW_FLOOR, "BLOCK")
        .when(vetoed, "REVIEW")
        .when(score >= AUTO_FLOOR, F.when(material, "CONFIRM").otherwise("AUTO_ACCEPT"))
        .when(score >= CONFIRM_FLOOR, "CONFIRM")
        .otherwise("REVIEW")
    )


def type_family(c: Column) -> Column:
    out = F.lit(None).cast("string")
    for family, names in TYPE_FAMILY.items():
        out = F.when(F.lower(F.trim(c)).isin(*names), family).otherwise(out)
    return out


def is_material(declared: Column) -> Column:
    """Whether a field's type is money or an identifier: such fields are never accepted unseen."""
    return F.coalesce(F.lower(F.trim(declared)).isin(*MONEY_TYPES, *IDENTIFIER_TYPES), F.lit(False))


def compare_types(declared: Column, observed: Column) -> Column:
    """COMPATIBLE, MISMATCH, or UNKNOWN where either is not known."""
    d, o = type_family(declared), type_family(observed)
    ok = F.lit(False)
    for family, accepted in ACCEPTS.items():
        ok = ok | ((d == family) & o.isin(*accepted))
    return F.when(d.isNull() | o.isNull(), "UNKNOWN").when(ok, "COMPATIBLE").otherwise("MISMATCH")


def disproportionality(a: Column, b: Column, c: Column, d: Column) -> dict[str, Column]:
    """prr, ror, chi2 (Yates), confidence bounds and flags of a 2 x 2 table; null where undefined."""
    a, b, c, d = (x.cast("double") for x in (a, b, c, d))
    prr = F.when((a > 0) & (c > 0), (a / (a + b)) / (c / (c + d)))
    se = F.when((a > 0) & (c > 0), F.sqrt(1 / a - 1 / (a + b) + 1 / c - 1 / (c + d)))
    defined = (a > 0) & (b > 0) & (c > 0) & (d > 0)
    ror = F.when(defined, (a * d) / (b * c))
    ror_se = F.when(defined, F.sqrt(1 / a + 1 / b + 1 / c + 1 / d))
    n, below = a + b + c + d, (a + b) * (c + d) * (a + c) * (b + d)
    chi2 = F.when((a > 0) & (below > 0), n * F.pow(F.greatest(F.lit(0.0), F.abs(a * d - b * c) - n / 2), F.lit(2.0)) / below)
    lower = F.exp(F.log(ror) - Z_95 * ror_se)
    return {
        "prr": prr,
        "prr_low": F.exp(F.log(prr) - Z_95 * se),
        "prr_high": F.exp(F.log(prr) + Z_95 * se),
        "ror": ror,
        "ror_low": lower,
        "ror_high": F.exp(F.log(ror) + Z_95 * ror_se),
        "chi2": chi2,
        "meets_evans": F.coalesce((a >= 3) & (prr >= 2) & (chi2 >= 4), F.lit(False)),
        "ror_above_one": F.coalesce((a >= 3) & (lower > 1), F.lit(False)),
        "notes": F.array_compact(
            F.array(
                F.when(a == 0, "not reported with this product"),
                F.when((a > 0) & (c == 0), "not reported in the background"),
                F.when((a > 0) & (b == 0), "every case with this product reports it"),
                F.when((a > 0) & (b > 0) & (d == 0), "every background case reports it"),
            )
        ),
    }


def jaccard(a: Column, b: Column) -> Column:
    """0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def closeness(a: Column, b: Column) -> Column:
    return F.when((a == 0) & (b == 0), 1.0).otherwise(1 - F.abs(a - b) / F.greatest(a, b, F.lit(1)))


def count_band(n: Column) -> Column:
    """0 to 4 at 20, 60, 150 and 300."""
    return F.when(n <= 20, 0).when(n <= 60, 1).when(n <= 150, 2).when(n <= 300, 3).otherwise(4)


def structural_similarity(a: Column, b: Column) -> Column:
    """Of two structs with codes, brackets (arrays), paragraph_band, table_paragraphs, blue_spans, red_spans. Weights of
    what neither names are given to the rest; shape alone counts 0.55 at most."""
    shape = F.when(a["paragraph_band"] == b["paragraph_band"], 0.4).otherwise(0.0) + 0.2 * (closeness(a["table_paragraphs"], b["table_paragraphs"]) + closeness(a["blue_spans"], b["blue_spans"]) + closeness(a["red_spans"], b["red_spans"]))
    codes, brackets = F.size(F.array_union(a["codes"], b["codes"])) > 0, F.size(F.array_union(a["brackets"], b["brackets"])) > 0
    weight = 0.3 + F.when(codes, 0.5).otherwise(0.0) + F.when(brackets, 0.2).otherwise(0.0)
    total = 0.3 * shape + F.when(codes, 0.5 * jaccard(a["codes"], b["codes"])).otherwise(0.0) + F.when(brackets, 0.2 * jaccard(a["brackets"], b["brackets"])).otherwise(0.0)
    return F.bround(F.when(codes | brackets, total / weight).otherwise(0.55 * shape), 4)


def family_decision(similarity: Column) -> Column:
    return F.when(similarity >= 0.90, "REUSE_MANIFEST").when(similarity >= 0.60, "REUSE_EVIDENCE").otherwise("NEW_FAMILY")


def cosine(a: Column, b: Column) -> Column:
    """Cosine in doubles; null where a vector is null or zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / norm)))


def structural_fingerprint(codes: Column, texts: Column, paragraphs: Column, table_paragraphs: Column, blue: Column, red: Column) -> Column:
    """Struct for structural_similarity from what a scan of a template found: merge-field codes, texts of its spans (whose
    square brackets count), numbers of paragraphs, of those in tables, and of coloured spans."""
    brackets = F.flatten(F.transform(texts, lambda t: F.regexp_extract_all(t, F.lit(r"\[([^\[\]]+)\]"), F.lit(1))))
    return F.struct(
        F.array_distinct(codes).alias("codes"), F.array_distinct(F.transform(brackets, lambda b: F.lower(F.trim(b)))).alias("brackets"), count_band(paragraphs).alias("paragraph_band"),
        table_paragraphs.alias("table_paragraphs"), blue.alias("blue_spans"), red.alias("red_spans"),
    )


def _prefixes(items, key: str, shape: str, part: str, least: dict[str, float]):
    """key, kind, token: of each item's codes or brackets the rarest first, as many as guarantee that two sets whose Jaccard index is
    least[kind] or more share one of them."""
    tokens = items.select(F.col(key).alias("k"), F.explode(F.array_distinct(F.col(shape)[part])).alias("token"))
    df = tokens.groupBy("token").agg(F.count("*").alias("df"))
    own = tokens.join(df, "token").groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "token"))), lambda x: x["token"]).alias("own"))
    n = F.size("own")
    kinds = [F.struct(F.lit(kind).alias("kind"), F.slice("own", F.lit(1), F.greatest(F.lit(0), (n - F.ceil(n * j - 1e-9) + 1).cast("int"))).alias("first")) for kind, j in least.items()]
    return own.select("k", F.explode(F.array(*kinds)).alias("p")).select("k", "p.kind", F.explode("p.first").alias("token"))


def similar_pairs(items, key: str, shape: str, least: float):
    """Pairs of templates (a < b) whose structures are similar. Over 0.55 they share codes or brackets, and how many follows from the
    score: with one paragraph band the shape can give all of its part, with two at most 0.6 of it, so pairs across bands share more.
    They meet by the rarest of their codes, those without codes by the rarest of their brackets; only ids move until the pairs are known."""
    if least <= 0.55:
        raise ValueError("pairs that share neither a code nor a bracket reach 0.55")
    t = least - 0.00005  # scores are rounded to four places
    about = items.select(F.col(key).alias("k"), F.col(shape)["paragraph_band"].alias("band"), (F.size(F.col(shape)["codes"]) > 0).alias("coded"))
    # Codes on either side: of 1 (0.8 without brackets) the shape gives 0.3 and the brackets 0.2 at most.
    codes = {k: max(0.0, min(t - 0.3 * s - 0.2, 0.8 * t - 0.3 * s) / 0.5) for k, s in (("same", 1.0), ("any", 0.6))}
    # No codes on either side: of 0.5 the shape gives 0.3 at most.
    brackets = {k: (0.5 * t - 0.3 * s) / 0.2 for k, s in (("same", 1.0), ("any", 0.6))}
    by = lambda rows, name: rows.join(about, "k").select("k", F.xxhash64(F.lit(name), "token", F.when(F.col("kind") == "same", F.col("band")).otherwise(F.lit(-1))).alias("block"))
    bare = items.join(about.where("not coded").select(F.col("k").alias(key)), key, "left_semi")
    met = by(_prefixes(items, key, shape, "codes", codes), "codes").unionByName(by(_prefixes(bare, key, shape, "brackets", {k: max(0.0, j) for k, j in brackets.items()}), "brackets"))
    if brackets["same"] <= 0:
        # Up to 0.6 a like shape is enough for templates without codes that have brackets: the band is all that they have to share.
        met = met.unionByName(about.where("not coded").select("k", F.xxhash64(F.lit("band"), "band").alias("block")))
    ids = met.select("block", F.col("k").alias("a")).join(met.select("block", F.col("k").alias("b")), "block").where("a < b").select("a", "b").distinct()
    side = lambda k: items.select(F.col(key).alias(k), F.col(shape).alias(f"s{k}"))
    return ids.join(side("a"), "a").join(side("b"), "b").select("a", "b", structural_similarity(F.col("sa"), F.col("sb")).alias("score")).where(F.col("score") >= least)
