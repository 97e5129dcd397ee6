"""Checks over drafted prose: findings with code, severity, message."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.functions import text as T
from tabloom.operators.joins import stored


def uncited_numbers(df: DataFrame, key: str, content: str) -> DataFrame:
    """Sentences with numbers and no [S..] marker."""
    s = df.select(key, F.explode(T.sentences(F.col(content))).alias("sentence"))
    bare = F.regexp_replace("sentence", r"\[[^\]]*\]", "")
    return s.where(bare.rlike(r"\d") & ~F.col("sentence").rlike(r"\[S\d+"))


def uncited_drafts(df: DataFrame, key: str, content: str, words: int = 40) -> DataFrame:
    return df.where((F.size(F.split(F.trim(content), r"\s+")) > words) & ~F.col(content).rlike(r"\[S\d+")).select(key)


def citation_values(citations: DataFrame, chunks: DataFrame) -> DataFrame:
    """Each cited number (marker, number) against its chunk: VERIFIED, NOT_IN_SOURCE, or CITATION_UNRESOLVED."""
    c = chunks.select(F.col("marker").alias("_m"), T.numbers_in(F.col("text")).alias("_n"))
    j = citations.join(c, F.col("marker") == F.col("_m"), "left")
    return j.withColumn("outcome", F.when(F.col("_m").isNull(), "CITATION_UNRESOLVED").when(F.array_contains("_n", T.normalise_number(F.col("number"))), "VERIFIED").otherwise("NOT_IN_SOURCE")).drop("_m", "_n")


def cross_section(counts: DataFrame, concept: str, value: str, section: str) -> DataFrame:
    """Concepts that sections state with more than one value."""
    g = counts.groupBy(concept).agg(F.array_sort(F.collect_set(value)).alias("values"), F.array_sort(F.collect_set(section)).alias("sections"))
    return g.where(F.size("values") > 1)


def data_needed(df: DataFrame, key: str, content: str) -> DataFrame:
    """Distinct gaps that a draft declares, whatever their case."""
    d = df.select(key, F.explode(T.data_needed(F.col(content))).alias("gap"))
    return d.groupBy(key, F.lower("gap").alias("_g")).agg(F.min("gap").alias("gap")).drop("_g")


def unknown_tables(df: DataFrame, key: str, content: str, known: list[str]) -> DataFrame:
    return df.select(key, F.explode(F.array_distinct(T.table_markers(F.col(content)))).alias("table")).where(~F.col("table").isin(*known) if known else F.lit(True))


def abbreviations(df: DataFrame, content: str) -> DataFrame:
    """Acronyms with how often they stand and whether any text spells them out."""
    d = df.select(F.col(content).alias("t"))
    use = d.select(F.explode(F.regexp_extract_all("t", F.lit(r"\b([A-Z][A-Z0-9]{1,7})\b"), F.lit(1))).alias("acronym")).groupBy("acronym").agg(F.count("*").alias("uses"))
    told = d.select(F.explode(F.regexp_extract_all("t", F.lit(r"[A-Za-z]\s+\(([A-Z][A-Z0-9]{1,7})\)"), F.lit(1))).alias("acronym")).distinct().withColumn("expanded", F.lit(True))
    return use.join(told, "acronym", "left").withColumn("expanded", F.coalesce("expanded", F.lit(False)))


def headline_counts(df: DataFrame, key: str, content: str) -> DataFrame:
    """Numbers beside words of disposition."""
    found = F.regexp_extract_all(F.lower(F.col(content)), F.lit(r"(\d[\d,]*)\s+(?:\w+\s+){0,2}(?:were\s+)?(randomi[sz]ed|enrolled|screened|treated|completed|discontinued|withdrawn)"), F.lit(0))
    return df.select(key, F.explode(found).alias("m")).select(key, F.regexp_replace(F.regexp_extract("m", r"(\d[\d,]*)", 1), ",", "").cast("long").alias("n"), F.regexp_extract("m", r"([a-z]+)$", 1).alias("what"))


def word_doublings(df: DataFrame, template: DataFrame, content: str, allowed: tuple[str, ...] = ("that", "had", "very")) -> DataFrame:
    """Doubled words beyond what the template itself has."""
    count = lambda d, n: d.select(F.explode(T.doubled_words(F.col(content))).alias("word")).groupBy("word").agg(F.count("*").alias(n))
    j = count(df, "n").join(count(template, "in_template"), "word", "left").withColumn("extra", F.col("n") - F.coalesce("in_template", F.lit(0)))
    return j.where((F.col("extra") > 0) & ~F.col("word").isin(*allowed))


#: Places of a paragraph that are cut from one piece of it, at least.
PIECE = 256


def lost_values(values: DataFrame, paragraphs: DataFrame, doc: str, value: str, text: str) -> DataFrame:
    """Filled values that no paragraph of their document holds, white space aside.

    A value starts with its first 2^k characters, as many as it has at least. What stands at each place of a paragraph is first looked up
    by such a start, then, in the lengths of the document's values with that start, as a whole value. So rows are as many as
    characters; no document's text is gathered, and no value is held against all paragraphs."""
    squeeze = lambda c: F.regexp_replace(F.trim(c), r"\s+", " ")
    short = lambda c: F.when(F.length(c) > 64, F.sha2(c, 256)).otherwise(c)
    cut = lambda c, at, n: F.substring(c, at + 1, n)
    v = values.where(F.trim(F.coalesce(F.col(value), F.lit(""))) != "").withColumn("_v", squeeze(F.col(value)))
    v = v.withColumn("_size", F.length("_v")).withColumn("_n", F.pow(F.lit(2), F.length(F.bin("_size")) - 1).cast("int"))
    starts = v.where(F.col(doc).isNotNull()).select(F.col(doc).alias("_d"), "_n", short(cut(F.col("_v"), F.lit(0), F.col("_n"))).alias("_s"), "_size").distinct()
    powers = [r["_n"] for r in starts.select("_n").distinct().collect()]  # 31 at most
    if not powers:
        return v.drop("_v", "_size", "_n")
    n, step = F.col("_n"), F.greatest(F.col("_n"), F.lit(PIECE))
    p = paragraphs.select(F.col(doc).alias("_d"), squeeze(F.col(text)).alias("_t")).where("_d is not null")
    p = p.select("_d", "_t", F.explode(F.array(*map(F.lit, powers))).alias("_n")).where(F.length("_t") >= n)
    # A piece has the places at which it is cut, and behind the last as much as the longest value of its power has.
    p = p.select("_d", "_n", "_t", F.explode(F.sequence(F.lit(0), F.floor((F.length("_t") - n) / step).cast("int"))).alias("_i")).select("_d", "_n", cut(F.col("_t"), F.col("_i") * step, step + 2 * n - 2).alias("_t"))
    p = p.select("_d", "_n", "_t", F.explode(F.sequence(F.lit(0), F.least(step, F.length("_t") - n + 1) - 1)).alias("_i"))
    places = p.select("_d", "_n", short(cut(F.col("_t"), F.col("_i"), n)).alias("_s"), cut(F.col("_t"), F.col("_i"), 2 * n - 1).alias("_at"))
    met = places.join(starts, ["_d", "_n", "_s"]).where(F.length("_at") >= F.col("_size"))
    held = met.select("_d", F.col("_size").alias("_l"), short(cut(F.col("_at"), F.lit(0), F.col("_size"))).alias("_h")).distinct()
    return v.join(held, (F.col(doc) == F.col("_d")) & (F.col("_size") == F.col("_l")) & (short(F.col("_v")) == F.col("_h")), "left_anti").drop("_v", "_size", "_n")


def too_long(values: DataFrame, limits: DataFrame, field: str, value: str) -> DataFrame:
    return values.join(limits, field).where(F.length(value) > F.col("max_len"))


def compendial_claims(df: DataFrame, key: str, content: str) -> DataFrame:
    return df.select(key, F.explode(F.regexp_extract_all(F.col(content), F.lit(r"\b((?:USP|Ph\.?\s?Eur\.?|JP|BP|NF)(?:\s*<\d+>)?)"), F.lit(1))).alias("claim"))


def route(findings: DataFrame, policy: DataFrame) -> DataFrame:
    """Findings with the severity of a policy; codes without one keep their own."""
    p = policy.select(F.col("code").alias("_c"), F.col("severity").alias("_s"))
    return findings.join(p, F.col("code") == F.col("_c"), "left").withColumn("severity", F.coalesce("_s", "severity")).drop("_c", "_s")


def branch_counts(verdicts: DataFrame, group: str, expected: int = 1) -> DataFrame:
    """Groups of alternative blocks of which not exactly one was kept, undecided ones told apart."""
    g = verdicts.groupBy(group).agg(F.count_if(F.col("verdict") == "KEEP").alias("kept"), F.count_if(F.col("verdict") == "UNDECIDED").alias("undecided"))
    return g.where((F.col("kept") != expected) | (F.col("undecided") > 0))


def manifest_faults(objects: DataFrame) -> DataFrame:
    """Duplicate ids and references to nothing, of rows (id, refers_to array)."""
    twice = objects.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("DUPLICATE_ID").alias("code"), F.col("id").alias("what"))
    refs = objects.select(F.explode("refers_to").alias("what")).distinct().join(objects.select(F.col("id").alias("what")), "what", "left_anti")
    return twice.unionByName(refs.select(F.lit("MISSING_REFERENCE").alias("code"), "what"))


def run(checks: dict) -> DataFrame:
    """Findings of all checks (name -> callable), blockers first. Each check is run here and its findings stored, so one that
    raises, while it is planned or while it runs, is itself a blocker and the others stand: it fails closed."""
    from tabloom.operators.lab import findings

    parts, spark = [], SparkSession.getActiveSession()
    for name, check in checks.items():
        try:
            parts.append(stored(check().select("code", "severity", "message"), "findings"))
        except Exception as e:  # noqa: BLE001
            parts.append(spark.createDataFrame([("QC_CHECK_FAILED", "blocker", f"{name}: {type(e).__name__}")], "code string, severity string, message string"))
    return findings(*parts)


def section_findings(df: DataFrame, key: str, content: str, known_tables: list[str]) -> DataFrame:
    """All that can be found in one section: uncited numbers, declared gaps and unknown tables, with the section's key."""
    part = lambda d, code, severity, what: d.select(F.col(key).cast("string").alias("section"), F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.col(what).alias("message"))
    return (
        part(uncited_numbers(df, key, content), "UNCITED_NUMBER", "warning", "sentence")
        .unionByName(part(data_needed(df, key, content), "DATA_NEEDED", "blocker", "gap"))
        .unionByName(part(unknown_tables(df, key, content, known_tables), "TABLE_UNKNOWN", "blocker", "table"))
    )


def orphaned_fields(slots: DataFrame, deleted: DataFrame, field: str, paragraph: str) -> DataFrame:
    """Fields all of whose slots stand in paragraphs that were deleted."""
    gone = deleted.select(paragraph).distinct().withColumn("_gone", F.lit(True))
    g = slots.join(gone, paragraph, "left").groupBy(field).agg(F.every(F.coalesce("_gone", F.lit(False))).alias("_all"), F.count("*").alias("slots"))
    return g.where("_all").drop("_all")
