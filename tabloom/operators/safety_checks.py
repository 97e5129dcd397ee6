"""Checks and tables of periodic safety reports. Findings have code, severity, message."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabloom.functions.text import data_needed, table_markers
from tabloom.operators.lab import finding

FIGURE = r"(?<![\w.])\d[\d,]*(?![\w.%])"


def reconciliation(counts: DataFrame) -> DataFrame:
    """Summary tabulation = listed + unassessed + unrelated, from one row of those counts."""
    bad = counts.where(F.col("summary") != F.col("listed") + F.col("unassessed") + F.col("unrelated"))
    return finding(bad, "RECONCILIATION", "blocker", F.format_string("summary %d, listed %d, unassessed %d, unrelated %d", "summary", "listed", "unassessed", "unrelated"))


def window_sanity(reports: DataFrame) -> DataFrame:
    """Reports (sequence, interval, cumulative): cumulative is not under the interval, nor under the report before."""
    w = W.partitionBy("product").orderBy("sequence")
    d = reports.withColumn("before", F.lag("cumulative").over(w))
    a = finding(d.where("cumulative < interval"), "CUMULATIVE_BELOW_INTERVAL", "blocker", F.format_string("report %d", "sequence"))
    return a.unionByName(finding(d.where("cumulative < before"), "CUMULATIVE_FELL", "blocker", F.format_string("report %d", "sequence")))


def volume_trend(reports: DataFrame) -> DataFrame:
    """Each interval against the one before, null for the first and over an empty one."""
    w = W.partitionBy("product").orderBy("sequence")
    return reports.withColumn("before", F.lag("interval").over(w)).withColumn("change", F.try_divide(F.col("interval") - F.col("before"), F.col("before").cast("double")))


def one_dictionary(events: DataFrame, declared: str, version: str = "dictionary_version") -> DataFrame:
    """Events of an interval share one dictionary version, the declared one."""
    g = events.where(F.col(version).isNotNull()).agg(F.array_sort(F.collect_set(version)).alias("v"))
    return finding(g.where((F.size("v") > 0) & (F.col("v") != F.array(F.lit(declared)))), "DICTIONARY_VERSION", "warning", F.array_join("v", ", "))


def uncoded(events: DataFrame, cases: DataFrame) -> DataFrame:
    n = events.where("coding_required").join(cases.select("case_id"), "case_id", "left_semi").agg(F.count("*").alias("n"))
    return finding(n.where("n > 0"), "UNCODED_EVENTS", "blocker", F.col("n").cast("string"))


def narratives_missing(cases: DataFrame, narratives: DataFrame, special: list[str]) -> DataFrame:
    """Fatal, life-threatening and special-interest cases without a narrative."""
    grave = F.arrays_overlap(F.coalesce("seriousness_criteria", F.array().cast("array<string>")), F.array(F.lit("death"), F.lit("life_threatening")))
    of_interest = F.arrays_overlap(F.coalesce("terms", F.array().cast("array<string>")), F.array(*[F.lit(s) for s in special])) if special else F.lit(False)
    missing = cases.where(grave | of_interest).join(narratives.select("case_id").distinct(), "case_id", "left_anti")
    return finding(missing, "NARRATIVE_MISSING", "warning", F.col("case_id").cast("string"))


def stale_expectedness(events: DataFrame, current: str) -> DataFrame:
    """Confirmed against another version of the reference information."""
    return finding(events.where(F.col("confirmed_by").isNotNull() & ~F.col("rsi_version").eqNullSafe(F.lit(current))), "RSI_VERSION", "warning", F.col("event_id").cast("string"))


def signal_hygiene(signals: DataFrame, lock) -> DataFrame:
    """Signals without a status, closed without a conclusion, and candidates from before the lock."""
    key = F.col("signal_id").cast("string")
    return (
        finding(signals.where("status is null"), "SIGNAL_NO_STATUS", "blocker", key)
        .unionByName(finding(signals.where("status = 'closed' and (conclusion is null or trim(conclusion) = '')"), "SIGNAL_CLOSED_INCOMPLETE", "warning", key))
        .unionByName(finding(signals.where((F.col("status") == "candidate") & (F.col("detected_on") <= F.lit(lock))), "SIGNAL_UNTRIAGED", "warning", key))
    )


def label_continuity(actions: DataFrame, versions: DataFrame) -> DataFrame:
    """Label changes with no reference version that takes effect on or after them."""
    latest = versions.agg(F.max("effective").alias("latest")).withColumn("_k", F.lit(1))
    d = actions.where("kind = 'label_change'").withColumn("_k", F.lit(1)).join(F.broadcast(latest), "_k", "left")
    return finding(d.where(F.col("latest").isNull() | (F.col("latest") < F.col("action_date"))), "LABEL_CHANGE", "warning", F.col("action_date").cast("string"))


def rates_without_exposure(sections: DataFrame, exposure: DataFrame) -> DataFrame:
    rate = sections.where(F.col("content").rlike(r"(?i)\bper\s+[\d,]+\s+(patients?|person|subject)|\bincidence\b|\breporting rate\b"))
    none = exposure.where("confirmed").agg((F.count("*") == 0).alias("none")).withColumn("_k", F.lit(1))
    return finding(rate.withColumn("_k", F.lit(1)).join(F.broadcast(none), "_k").where("none"), "RATE_WITHOUT_DENOMINATOR", "blocker", F.col("section"))


def allowed_figures(cells: DataFrame) -> DataFrame:
    """Whole numbers that the tables hold."""
    return cells.select(F.explode("cells").alias("figure")).where(F.col("figure").rlike(r"^\d+$")).distinct()


def unsourced_figures(sections: DataFrame, cells: DataFrame) -> DataFrame:
    """Whole numbers in prose that no table holds."""
    said = sections.select("section", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(f"({FIGURE})"), F.lit(1)))).alias("figure")).withColumn("figure", F.regexp_replace("figure", ",", ""))
    return said.join(allowed_figures(cells), "figure", "left_anti")


def markers(sections: DataFrame, known: list[str]) -> DataFrame:
    """Unknown tables, declared gaps and assessments still to be made."""
    t = sections.select(F.explode(table_markers(F.col("content"))).alias("m")).where(~F.col("m").isin(*known) if known else F.lit(True))
    gaps = sections.select(F.explode(data_needed(F.col("content"))).alias("m"))
    open_ = sections.where(F.col("content").contains("[ASSESSMENT REQUIRED"))
    return finding(t, "TABLE_UNKNOWN", "blocker", F.col("m")).unionByName(finding(gaps, "DATA_NEEDED", "blocker", F.col("m"))).unionByName(finding(open_, "ASSESSMENT_REQUIRED", "blocker", F.col("section")))


def bound_cases(bound: DataFrame, cases: DataFrame, label: Column) -> DataFrame:
    """Cases that a section is bound to: missing, after the lock, or undated."""
    c = cases.select(F.col("case_id").alias("_c"), label.alias("_w"))
    j = bound.join(c, F.col("case_id") == F.col("_c"), "left")
    state = F.when(F.col("_c").isNull(), "missing").when(F.col("_w").isin("after_lock", "undated"), F.col("_w"))
    return finding(j.withColumn("_s", state).where("_s is not null"), "BOUND_CASE", "blocker", F.concat_ws(" ", F.col("case_id").cast("string"), "_s"))


def figure_drift(signed: DataFrame, now: DataFrame) -> DataFrame:
    """Figures (key, value) that changed since sign-off, null-safe."""
    j = signed.select("key", F.col("value").alias("a")).join(now.select("key", F.col("value").alias("b")), "key", "full")
    return finding(j.where(~F.col("a").eqNullSafe(F.col("b"))), "FIGURE_CHANGED", "warning", F.col("key"))


def regions_due(targets: DataFrame) -> DataFrame:
    """Regions of a report without a recorded date."""
    left = targets.withColumn("due", F.array_sort(F.array_except("targets", "recorded")))
    return finding(left.where(F.size("due") > 0), "REGION_DUE", "warning", F.array_join("due", ", "))


def unconfirmed(events: DataFrame, cases: DataFrame, sections: list[str]) -> DataFrame:
    """Events of the report's cases whose assessment nobody confirmed, where a section prints them."""
    n = events.where("confirmed_by is null").join(cases.select("case_id"), "case_id", "left_semi").agg(F.count("*").alias("n"))
    return finding(n.where((F.col("n") > 0) & F.lit(bool(sections))), "UNCONFIRMED_DATA", "blocker", F.concat_ws(" ", F.col("n").cast("string"), F.lit(", ".join(sections))))


def carried_figures(sections: DataFrame) -> DataFrame:
    """Sections carried over from the report before whose text still quotes counts."""
    said = sections.where("carried").withColumn("_f", F.regexp_extract_all("content", F.lit(f"({FIGURE})"), F.lit(1)))
    return finding(said.where(F.size("_f") > 0), "BASELINE_FIGURE_CARRIED", "warning", F.concat_ws(" ", "section", F.array_join(F.slice("_f", 1, 3), ", ")))


def stated_figures(counts: DataFrame, tables: DataFrame) -> DataFrame:
    """key, value of all figures that a report states: its counts (key, value) and the totals of its tables (table, cells)."""
    totals = tables.groupBy(F.concat(F.lit("total:"), F.col("table")).alias("key")).agg(F.sum(F.aggregate(F.transform("cells", lambda c: F.coalesce(c.try_cast("long"), F.lit(0))), F.lit(0).cast("long"), lambda a, b: a + b)).alias("value"))
    return counts.select("key", F.col("value").cast("long").alias("value")).unionByName(totals)


def unapproved(sections: DataFrame) -> DataFrame:
    """Enabled sections without an approval or without a text."""
    d = sections.where("enabled")
    return finding(d.where("approved_by is null"), "SECTION_NOT_APPROVED", "blocker", F.col("section")).unionByName(finding(d.where("trim(coalesce(content, '')) = ''"), "SECTION_EMPTY", "blocker", F.col("section")))


def quality_run(checks: dict, accepted: DataFrame) -> DataFrame:
    """All checks of a report (name -> callable) in one list, blockers first; what somebody accepted is a warning."""
    from tabloom.operators.lab import findings
    from tabloom.operators.text_checks import run

    return findings(downgrade(run(checks), accepted))


def downgrade(findings: DataFrame, accepted: DataFrame) -> DataFrame:
    """Blockers that somebody accepted are warnings."""
    a = accepted.select("code", "message").distinct().withColumn("_ok", F.lit(True))
    j = findings.join(a, ["code", "message"], "left")
    return j.withColumn("severity", F.when(F.col("_ok") & (F.col("severity") == "blocker"), "warning").otherwise(F.col("severity"))).drop("_ok")


# Tables

#: Order of safety concern categories.
CONCERNS = ("important identified risk", "important potential risk", "missing information")


def signals_in_report(signals: DataFrame, start, end, lock) -> DataFrame:
    """Signals that are open or were closed in the period, detected by the lock; refuted ones and candidates are left out."""
    shown = F.col("status").isin("new", "ongoing") | ((F.col("status") == "closed") & F.col("closed_on").between(F.lit(start), F.lit(end)))
    return signals.where(shown & (F.col("detected_on") <= F.lit(lock)))


def signal_overview(signals: DataFrame) -> DataFrame:
    """Signals with what their row lacks."""
    lacks = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in ("detected_on", "source", "conclusion")]))
    return signals.withColumn("missing", F.array_join(lacks, ", ")).orderBy("detected_on", "signal_id")


def exposure_table(exposure: DataFrame) -> DataFrame:
    return exposure.withColumn("note", F.when(F.col("patients").isNull(), "no estimate")).orderBy("context", "region", F.col("patients").asc_nulls_first())


def concern_table(concerns: DataFrame) -> DataFrame:
    at = F.array_position(F.array(*[F.lit(c) for c in CONCERNS]), F.lower("category"))
    return concerns.withColumn("_at", F.when(at > 0, at).otherwise(len(CONCERNS) + 1)).orderBy("_at", F.lower("concern"), "concern").drop("_at")


def action_table(actions: DataFrame, start, end) -> DataFrame:
    """Actions of the period, and undated ones marked."""
    return actions.where(F.col("action_date").isNull() | F.col("action_date").between(F.lit(start), F.lit(end))).withColumn("undated", F.col("action_date").isNull()).orderBy(F.col("action_date").asc_nulls_last(), "kind")


def approvals(status: DataFrame) -> DataFrame:
    return status.orderBy("country", F.col("approved_on").asc_nulls_last())


def literature(refs: DataFrame, start, end) -> DataFrame:
    return refs.where(F.col("published").isNull() | F.col("published").between(F.lit(start), F.lit(end))).withColumn("linked", F.size(F.coalesce("case_ids", F.array().cast("array<string>")))).orderBy(F.col("published").asc_nulls_last(), "title")


def listed_terms(terms: DataFrame) -> DataFrame:
    return terms.orderBy(F.lower("soc"), F.lower("pt"), "soc", "pt")
