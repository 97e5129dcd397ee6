"""Metrics that hold a value or a reason why there is none, percentiles, calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def metric(key: str, value: Column, reason: Column, sample: Column | None = None) -> Column:
    """struct<key, value, unavailable_reason, sample>: exactly one of value and reason is set."""
    return F.struct(F.lit(key).alias("key"), F.when(reason.isNull(), value.cast("double")).alias("value"), reason.alias("unavailable_reason"), (sample if sample is not None else F.lit(None)).cast("long").alias("sample"))


def ratio(n: Column, d: Column, places: int | None = 4) -> Column:
    """Null over an empty denominator, not zero."""
    r = F.when(d > 0, n / d)
    return r if places is None else F.bround(r, places)


def guarded_rate(df: DataFrame, key: str, n: Column, d: Column, empty: str) -> DataFrame:
    """One-row metric of two aggregates."""
    row = df.agg(n.alias("n"), d.alias("d"))
    return row.select(metric(key, F.col("n") / F.col("d"), F.when(F.col("d") == 0, F.lit(empty)), F.col("d")).alias("m")).select("m.*")


def latest_n(df: DataFrame, key: str, order: list, n: int = 5000) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def slo_report(df: DataFrame, key: str, duration: str, failed: Column, order: list, n: int = 5000) -> DataFrame:
    """Nearest-rank percentiles of the latest n rows per key; failures are counted and not timed."""
    d = latest_n(df, key, order, n).withColumn("_d", F.when(~failed, F.col(duration)))
    pct = lambda q: F.expr(f"percentile_disc({q}) within group (order by _d)")
    return d.groupBy(key).agg(F.count("_d").alias("samples"), F.count_if(failed).alias("errors"), pct(0.5).alias("p50"), pct(0.95).alias("p95"), F.max("_d").alias("slowest"))


def blocked_by_check(df: DataFrame, check: str, blocked: Column) -> DataFrame:
    """Blocked rows by check, most first, then by name."""
    return df.where(blocked).groupBy(F.col(check).alias("check_name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "check_name")


def more_than_one(df: DataFrame, key: str, name: str, empty: str = "nothing was produced") -> DataFrame:
    """Share of keys with more than one row."""
    per = df.groupBy(key).agg(F.count("*").alias("n"))
    return guarded_rate(per, name, F.count_if(F.col("n") > 1), F.count("*"), empty)


def time_to_first(starts: DataFrame, firsts: DataFrame, key: str, start: str, first: str) -> DataFrame:
    """Median, least and most days from a key's start to its first row, over the keys that have one."""
    f = firsts.groupBy(key).agg(F.min(first).alias("_first"))
    s = starts.groupBy(key).agg(F.min(start).alias("_start"))
    days = (F.unix_timestamp(F.col("_first").cast("timestamp")) - F.unix_timestamp(F.col("_start").cast("timestamp"))) / 86400.0
    d = s.join(f, key).select(days.alias("days"))
    return d.agg(F.count("*").alias("n"), F.median("days").alias("median_days"), F.min("days").alias("min_days"), F.max("days").alias("max_days"))


def churn_per_quarter(df: DataFrame, key: str, window_days: int) -> DataFrame:
    """Mean rows per key, projected from the window to a quarter of 91.3125 days."""
    per = df.groupBy(key).agg(F.count("*").alias("n"))
    return per.agg((F.avg("n") * 91.3125 / window_days).alias("per_quarter"), F.count("*").alias("keys"))


def histogram(df: DataFrame, key: str, known: list[str]) -> DataFrame:
    """Counts of the known values, zero where there are none, and of any others."""
    counts = df.groupBy(F.col(key).alias("value")).agg(F.count("*").alias("n"))
    names = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(k) for k in known])).alias("value"))
    return names.join(counts, "value", "full").select("value", F.coalesce("n", F.lit(0)).alias("n"))


def readiness(requirements: DataFrame, sources: DataFrame, kind: str, done: str) -> DataFrame:
    """Each required kind: uploaded, done; and whether all required ones are done (on each row)."""
    have = sources.groupBy(kind).agg(F.count("*").alias("uploaded"), F.count_if(F.col(done)).alias("ready"))
    r = requirements.join(have, kind, "left").withColumns({"uploaded": F.coalesce("uploaded", F.lit(0)), "ready": F.coalesce("ready", F.lit(0))})
    return r.withColumn("all_required_ready", F.coalesce(F.every(F.when(F.col("required"), F.col("ready") > 0)).over(W.partitionBy(F.lit(0))), F.lit(True)))


def batch_projection(df: DataFrame, elapsed: str, rows: str) -> DataFrame:
    """Time for a thousand rows at the rate of each batch; batches without rows are left out."""
    return df.where(F.col(rows) > 0).withColumn("per_thousand", F.col(elapsed) / F.col(rows) * 1000)


def k_anonymous(df: DataFrame, pattern: list[str], tenant: str, weight: str, k: int = 3) -> DataFrame:
    """Patterns that at least k tenants share."""
    return df.groupBy(*pattern).agg(F.countDistinct(tenant).alias("tenants"), F.sum(weight).alias("weight")).where(F.col("tenants") >= k)


def canary_positions(n: int, size: int = 3) -> list[int]:
    """Evenly spaced rows to run first."""
    return sorted({min(n - 1, i * n // size) for i in range(size)}) if n > 0 else []


def column_types(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, non_empty, observed_type (date, number, boolean, text; null for an empty column). Every value has to agree:
    one word among numbers makes a column of text. One pass over all columns."""
    from tabloom.functions.dates import parse_any
    from tabloom.functions.values import as_number

    aggs = []
    for c in columns:
        t = F.trim(F.col(c).cast("string"))
        kind = F.when(F.coalesce(t, F.lit("")) == "", None).when(parse_any(t).isNotNull(), "date").when(as_number(t).isNotNull(), "number").when(F.lower(t).isin("true", "false", "yes", "no", "y", "n"), "boolean").otherwise("text")
        aggs += [F.count(F.when(t != "", 1)).alias(f"n_{c}"), F.collect_set(kind).alias(f"k_{c}")]
    row = df.agg(*aggs)
    parts = [F.struct(F.lit(c).alias("column"), F.col(f"n_{c}").alias("non_empty"), F.when(F.size(f"k_{c}") == 0, None).when(F.size(f"k_{c}") == 1, F.get(F.col(f"k_{c}"), F.lit(0))).otherwise("text").alias("observed_type")) for c in columns]
    return row.select(F.explode(F.array(*parts)).alias("p")).select("p.*")


def escaped_error_rate(generations: DataFrame, suggestions: DataFrame, approvals: DataFrame) -> DataFrame:
    """Errors found after approval per 10,000 fields written; three reasons for having no figure, told apart."""
    k = lambda d: d.withColumn("_k", F.lit(1))
    g = k(generations.agg(F.coalesce(F.sum(F.size("fields")), F.lit(0)).alias("fields")))
    a = k(approvals.agg(F.count("*").alias("approved")))
    e = k(suggestions.agg(F.count_if(F.col("found_after_approval")).alias("errors"), F.count_if(F.col("found_after_approval").isNotNull()).alias("reviewed")))
    row = g.join(F.broadcast(a), "_k").join(F.broadcast(e), "_k")
    reason = F.when(F.col("approved") == 0, "nothing was approved").when(F.col("fields") == 0, "no field was written").when(F.col("reviewed") == 0, "nothing was reviewed after approval")
    return row.select(metric("escaped_error_rate", F.col("errors") * 10000.0 / F.greatest("fields", F.lit(1)), reason, F.col("fields")).alias("m")).select("m.*")


def family_reuse_rate(templates: DataFrame, members: DataFrame) -> DataFrame:
    """Templates that joined an approved family, of all templates."""
    reused = members.where("approved").select("template_id").distinct().withColumn("_r", F.lit(True))
    return guarded_rate(templates.select("template_id").distinct().join(reused, "template_id", "left"), "family_reuse_rate", F.count("_r"), F.count("*"), "no template was uploaded in this window")


def all_metrics(*rows: DataFrame) -> DataFrame:
    """One-row metrics in the order given."""
    out = None
    for i, r in enumerate(rows):
        r = r.withColumn("rank", F.lit(i))
        out = r if out is None else out.unionByName(r)
    return out.orderBy("rank")


def project_flags(projects: DataFrame, parts: dict[str, DataFrame], key: str = "project_id") -> DataFrame:
    """has_<part> for each part with a row of the project."""
    out = projects
    for name, df in parts.items():
        out = out.join(df.select(key).distinct().withColumn(f"has_{name}", F.lit(True)), key, "left").withColumn(f"has_{name}", F.coalesce(f"has_{name}", F.lit(False)))
    return out


def timings(calls: DataFrame, operation: str, seconds: str) -> DataFrame:
    """Calls and times of each operation, nearest-rank percentiles as everywhere."""
    pct = lambda q: F.expr(f"percentile_disc({q}) within group (order by {seconds})")
    return calls.groupBy(operation).agg(F.count("*").alias("calls"), F.avg(seconds).alias("mean"), pct(0.5).alias("p50"), pct(0.95).alias("p95"), F.max(seconds).alias("slowest"))


def by_state(df: DataFrame, by: str, status: str, states: dict[str, str]) -> DataFrame:
    """Rows by a kind, with one count for each state (name -> stored value)."""
    return df.groupBy(by).agg(*[F.count_if(F.col(status) == v).alias(n) for n, v in states.items()])


def touches(decisions: DataFrame, decided: Column, template: str) -> DataFrame:
    """Decisions by people, templates, and decisions per template."""
    g = decisions.agg(F.count_if(decided).alias("decisions"), F.countDistinct(template).alias("templates"))
    return g.withColumn("per_template", ratio(F.col("decisions"), F.col("templates"), None))


def profile_texts(types: DataFrame) -> DataFrame:
    """One sentence for each column of column_types, as a chunk that retrieval can find."""
    kind = F.coalesce(F.concat(F.lit("looks like "), F.col("observed_type")), F.lit("is empty"))
    return types.select("column", F.concat(F.lit("Column "), "column", F.lit(" holds "), F.col("non_empty").cast("string"), F.lit(" values and "), kind, F.lit(".")).alias("text"))
