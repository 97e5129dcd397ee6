"""Queries over the driver's tables, with DuckDB SQL that computes the same rows.

Roles: usage facts are `events`, documents `orders`, versions and results `lineitem`, templates and tests `part`, dimensions
`customer nation supplier`, chunks `documents`, vectors `embeddings`."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.functions import dates, scores, text, values
from tabloom.operators import conditions, formulas, lab, metrics, privacy, retrieval, safety, usage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

SINCE, UNTIL = datetime(2024, 1, 3), datetime(2024, 1, 28, 12)
TYPES = ["click", "error", "purchase", "signup", "view"]
WINDOW_SQL = "ts >= TIMESTAMP '2024-01-03 00:00:00' AND ts < TIMESTAMP '2024-01-28 12:00:00'"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def day(c) -> F.Column:
    return c.cast("date").cast("string")


def events(spark: SparkSession, d: str) -> DataFrame:
    """Usage facts; a cost is missing where its value is under 1."""
    return read(spark, d, "events").withColumn("org", (F.col("user_id") % 10).cast("string")).withColumn("cost", F.when(F.col("value") >= 1, F.col("value")))


EVENTS = "(SELECT *, CAST(user_id % 10 AS VARCHAR) AS org, CASE WHEN value >= 1 THEN value END AS cost FROM events) e"


# Usage


@query(f"SELECT count(*) AS calls, round(sum(cost), 4) AS cost, sum(user_id)::BIGINT AS tokens, count(*) FILTER (cost IS NULL) AS unpriced FROM {EVENTS} WHERE {WINDOW_SQL}")
def usage_summary(spark, d):
    out = usage.usage_summary(usage.in_window(events(spark, d), SINCE, UNTIL), {"cost": "cost", "tokens": "user_id"}, "cost")
    return out.withColumn("cost", F.round("cost", 4))


@query(f"SELECT event_type AS key, count(*) AS calls, round(sum(cost), 4) AS cost FROM {EVENTS} WHERE {WINDOW_SQL} GROUP BY 1")
def usage_by_type(spark, d):
    return usage.grouped_cost(usage.in_window(events(spark, d), SINCE, UNTIL), "event_type", "cost").withColumn("cost", F.round("cost", 4))


@query(f"SELECT t.key, round(t.cost, 4) AS cost, coalesce(c_name, '(deleted)') AS name FROM (SELECT user_id AS key, sum(cost) AS cost FROM {EVENTS} GROUP BY 1 ORDER BY 2 DESC NULLS LAST, 1 LIMIT 10) t LEFT JOIN customer ON c_custkey = t.key")
def usage_top_k(spark, d):
    return usage.top_k_with_names(events(spark, d), "user_id", "cost", read(spark, d, "customer"), "c_custkey", "c_name").withColumn("cost", F.round("cost", 4))


@query(f"SELECT CASE event_type WHEN 'click' THEN 'Browsing' WHEN 'view' THEN 'Browsing' WHEN 'purchase' THEN 'Buying' ELSE 'Other' END AS activity, count(*) AS calls, round(sum(cost), 4) AS cost FROM {EVENTS} GROUP BY 1")
def usage_relabelled(spark, d):
    return usage.relabelled(events(spark, d), "event_type", {"click": "Browsing", "view": "Browsing", "purchase": "Buying"}, "Other", "cost").withColumn("cost", F.round("cost", 4))


def _trend_sql(step: int) -> str:
    sums = ", ".join(f"round(coalesce(sum(value) FILTER (event_type = '{t}'), 0), 4) AS \"{t}\"" for t in TYPES)
    return (
        f"WITH s AS (SELECT CAST(b AS DATE) AS bucket FROM generate_series(TIMESTAMP '2024-01-03', TIMESTAMP '2024-01-28 12:00:00', INTERVAL {step} DAY) g(b)), "
        f"e AS (SELECT *, CAST(DATE '2024-01-03' + CAST(date_diff('day', DATE '2024-01-03', CAST(ts AS DATE)) - date_diff('day', DATE '2024-01-03', CAST(ts AS DATE)) % {step} AS INTEGER) AS DATE) AS bucket FROM events WHERE {WINDOW_SQL}) "
        f"SELECT CAST(s.bucket AS VARCHAR) AS bucket, {sums} FROM s LEFT JOIN e ON s.bucket = e.bucket GROUP BY 1"
    )


def _trend(spark, d, step):
    out = usage.trend_by(events(spark, d), SINCE, UNTIL, "event_type", TYPES, "value", step)
    return out.select(day(F.col("bucket")).alias("bucket"), *[F.round(t, 4).alias(t) for t in TYPES])


@query(_trend_sql(1))
def usage_trend_daily(spark, d):
    return _trend(spark, d, 1)


@query(_trend_sql(7))
def usage_trend_weekly(spark, d):
    return _trend(spark, d, 7)


@query("WITH s AS (SELECT CAST(b AS DATE) AS bucket FROM generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '1995-12-31', INTERVAL 7 DAY) g(b)), o AS (SELECT CAST(DATE '1995-01-01' + CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) - date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) % 7 AS INTEGER) AS DATE) AS bucket FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1995-12-31') SELECT CAST(s.bucket AS VARCHAR) AS bucket, count(o.bucket) AS value FROM s LEFT JOIN o ON s.bucket = o.bucket GROUP BY 1")
def docs_trend(spark, d):
    out = usage.trend(read(spark, d, "orders"), datetime(1995, 1, 1), datetime(1995, 12, 31), 7, "o_orderdate")
    return out.select(day(F.col("bucket")).alias("bucket"), "value")


@query("SELECT o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 1 UNION ALL SELECT 'X', 0")
def status_mix(spark, d):
    return metrics.histogram(read(spark, d, "orders"), "o_orderstatus", ["F", "O", "P", "X"])


@query("SELECT 'approval_rate' AS key, count(*) FILTER (o_orderstatus = 'F') / count(*) AS value, CAST(NULL AS VARCHAR) AS unavailable_reason, count(*) AS sample FROM orders UNION ALL SELECT 'empty_window', NULL, 'No document in this window.', 0")
def approval_rate(spark, d):
    o = read(spark, d, "orders")
    ok = F.count_if(F.col("o_orderstatus") == "F")
    full = metrics.guarded_rate(o, "approval_rate", ok, F.count("*"), "No document in this window.")
    return full.unionByName(metrics.guarded_rate(o.where("o_orderdate < timestamp_ntz'1900-01-01'"), "empty_window", ok, F.count("*"), "No document in this window."))


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events), l AS (SELECT *, CASE WHEN value >= 5 THEN value END AS v FROM r WHERE r <= 1000) SELECT event_type, count(v) AS samples, count(*) FILTER (value < 5) AS errors, quantile_disc(v, 0.5) AS p50, quantile_disc(v, 0.95) AS p95, max(v) AS slowest FROM l GROUP BY 1")
def slo_percentiles(spark, d):
    return metrics.slo_report(read(spark, d, "events"), "event_type", "value", F.col("value") < 5, [F.desc("ts"), F.desc("event_id")], 1000)


@query("SELECT event_type AS check_name, count(*) AS n FROM events WHERE value > 20 GROUP BY 1")
def block_rate_by_check(spark, d):
    return metrics.blocked_by_check(read(spark, d, "events"), "event_type", F.col("value") > 20)


@query("WITH c AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS returned FROM lineitem GROUP BY 1) SELECT o_orderkey, o_orderstatus, n AS event_count, returned AS coding_required FROM orders JOIN c ON l_orderkey = o_orderkey WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49) AND o_orderpriority ILIKE '%urgent%'")
def grid_with_counts(spark, d):
    li = read(spark, d, "lineitem")
    per = li.groupBy("l_orderkey").agg(F.count("*").alias("event_count"), F.count_if(F.col("l_returnflag") == "R").alias("coding_required"))
    hit = li.where("l_quantity > 49").select("l_orderkey")
    o = usage.search(read(spark, d, "orders"), "urgent", ["o_orderpriority"]).join(hit, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")
    return o.join(per, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "o_orderstatus", "event_count", "coding_required")


@query("SELECT o_orderpriority AS kind, count(*) FILTER (o_orderstatus = 'O') AS open, count(*) FILTER (o_orderstatus = 'F') AS resolved, count(*) FILTER (o_orderstatus = 'P') AS dismissed FROM orders GROUP BY 1")
def review_summary(spark, d):
    o = read(spark, d, "orders").withColumnRenamed("o_orderpriority", "kind")
    return metrics.by_state(o, "kind", "o_orderstatus", {"open": "O", "resolved": "F", "dismissed": "P"})


@query("WITH r(lang, required) AS (VALUES ('en', true), ('de', true), ('xx', false)), h AS (SELECT lang, count(*) AS uploaded, count(*) FILTER (quality = 1) AS ready FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1), j AS (SELECT r.lang, r.required, coalesce(uploaded, 0) AS uploaded, coalesce(ready, 0) AS ready FROM r LEFT JOIN h ON h.lang = r.lang) SELECT *, (SELECT bool_and(ready > 0) FROM j WHERE required) AS all_required_ready FROM j")
def readiness(spark, d):
    req = spark.createDataFrame([("en", True), ("de", True), ("xx", False)], "lang string, required boolean")
    docs = read(spark, d, "documents").select("doc_id", "lang").join(read(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left").withColumn("done", F.col("quality") == 1)
    return metrics.readiness(req, docs, "lang", "done")


@query("WITH c AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) SELECT 'regeneration_rate' AS key, count(*) FILTER (n > 1) / count(*) AS value, CAST(NULL AS VARCHAR) AS unavailable_reason, count(*) AS sample FROM c")
def regeneration_rate(spark, d):
    return metrics.more_than_one(read(spark, d, "lineitem").select("l_orderkey"), "l_orderkey", "regeneration_rate")


@query("WITH f AS (SELECT o_custkey, min(o_orderdate) AS f FROM orders GROUP BY 1), x AS (SELECT date_diff('second', TIMESTAMP '1992-01-01', f) / 86400.0::DOUBLE AS days FROM f JOIN customer ON c_custkey = o_custkey) SELECT count(*) AS n, median(days) AS median_days, min(days) AS min_days, max(days) AS max_days FROM x")
def time_to_first(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey")).withColumn("start", F.lit("1992-01-01").cast("timestamp_ntz"))
    return metrics.time_to_first(c, read(spark, d, "orders").select("o_custkey", "o_orderdate"), "o_custkey", "start", "o_orderdate")


@query("WITH c AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) SELECT round(avg(n) * 91.3125 / 90, 6) AS per_quarter, count(*) AS keys FROM c")
def churn_per_quarter(spark, d):
    return metrics.churn_per_quarter(read(spark, d, "lineitem").select("l_partkey"), "l_partkey", 90).withColumn("per_quarter", F.round("per_quarter", 6))


@query("SELECT count(*) FILTER (l_returnflag <> 'N') AS decisions, count(DISTINCT l_partkey) AS templates, count(*) FILTER (l_returnflag <> 'N') / count(DISTINCT l_partkey) AS per_template FROM lineitem")
def reviewer_touches(spark, d):
    return metrics.touches(read(spark, d, "lineitem"), F.col("l_returnflag") != "N", "l_partkey")


@query("SELECT 'auto_map_rate' AS key, count(*) FILTER (event_type = 'purchase') / count(*) FILTER (event_type IN ('purchase', 'error')) AS value, CAST(NULL AS VARCHAR) AS unavailable_reason, count(*) FILTER (event_type IN ('purchase', 'error')) AS sample FROM events")
def auto_map_rate(spark, d):
    t = F.col("event_type")
    return metrics.guarded_rate(read(spark, d, "events"), "auto_map_rate", F.count_if(t == "purchase"), F.count_if(t.isin("purchase", "error")), "Nothing was decided in this window.")


# Safety

SCOPE = safety.Scope("1", "BUILDING", date(1995, 1, 1), date(1995, 6, 30), date(1995, 7, 15), date(1994, 1, 1))


def cases(spark, d) -> DataFrame:
    c = read(spark, d, "customer").select("c_custkey", "c_mktsegment")
    o = read(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    return o.select(
        F.col("o_orderkey").alias("case_id"), F.lit("1").alias("org_id"), F.col("c_mktsegment").alias("product"), F.when(F.col("o_orderkey") % 50 != 0, F.col("o_orderdate").cast("date")).alias("initial_receipt_date"),
        F.when((F.col("o_orderkey") % 50 != 0) & (F.col("o_orderkey") % 3 == 0), F.date_add(F.col("o_orderdate").cast("date"), 30)).alias("latest_receipt_date"), (F.col("o_orderstatus") == "F").alias("is_serious"), F.col("o_orderpriority").alias("term"),
    )


CASES = "(SELECT o_orderkey AS case_id, c_mktsegment AS product, CASE WHEN o_orderkey % 50 <> 0 THEN CAST(o_orderdate AS DATE) END AS rd, CASE WHEN o_orderkey % 50 <> 0 THEN CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS DATE) + 30 ELSE CAST(o_orderdate AS DATE) END END AS vd, o_orderstatus = 'F' AS serious, o_orderpriority AS term FROM orders JOIN customer ON o_custkey = c_custkey) c"
IN_INTERVAL = "vd <= DATE '1995-07-15' AND rd BETWEEN DATE '1995-01-01' AND DATE '1995-06-30'"


@query(f"SELECT count(*) FILTER (product = 'BUILDING') AS stored, count(*) FILTER (product = 'BUILDING' AND {IN_INTERVAL}) AS interval, count(*) FILTER (product = 'BUILDING' AND vd <= DATE '1995-07-15' AND rd >= DATE '1994-01-01') AS cumulative, count(*) FILTER (product = 'BUILDING' AND rd IS NULL) AS undated, count(*) FILTER (product = 'BUILDING' AND vd > DATE '1995-07-15') AS after_lock, count(*) FILTER (product = 'BUILDING' AND {IN_INTERVAL} AND serious) AS interval_serious, count(*) FILTER (product <> 'BUILDING' AND {IN_INTERVAL}) AS background FROM {CASES}")
def window_preview(spark, d):
    return safety.preview(cases(spark, d), SCOPE)


@query(f"SELECT CASE WHEN rd IS NULL THEN 'undated' WHEN vd > DATE '1995-07-15' THEN 'after_lock' WHEN rd BETWEEN DATE '1995-01-01' AND DATE '1995-06-30' THEN 'interval' WHEN rd >= DATE '1994-01-01' THEN 'cumulative' ELSE 'outside' END AS label, count(*) AS n FROM {CASES} WHERE product = 'BUILDING' GROUP BY 1")
def window_label(spark, d):
    return cases(spark, d).where(safety.own(SCOPE)).groupBy(safety.window_label(SCOPE).alias("label")).agg(F.count("*").alias("n"))


def case_events(spark, d) -> DataFrame:
    return read(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("case_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("event_id"), F.col("l_shipdate").isNotNull().alias("_x"), F.col("l_linestatus").alias("soc"), F.col("l_returnflag").alias("pt"),
        F.when(F.col("l_quantity") > 25, "listed").otherwise("unlisted").alias("expectedness"), F.when(F.col("l_linenumber") <= 4, "u").alias("confirmed_by"), (F.col("l_discount") > 0.05).alias("event_serious"),
    ).drop("_x")


def _crosstab_sql() -> str:
    serious = "CASE WHEN l_linenumber <= 4 THEN l_discount > 0.05 ELSE l_discount > 0.05 OR serious END"
    bucket = "CASE WHEN l_linenumber <= 4 THEN CASE WHEN l_quantity > 25 THEN 'listed' ELSE 'unlisted' END ELSE 'unconfirmed' END"
    win = {"interval": IN_INTERVAL, "cumulative": "vd <= DATE '1995-07-15' AND rd >= DATE '1994-01-01'"}
    cols = [f"count(*) FILTER (product = 'BUILDING' AND {w} AND {'NOT ' if s == 'other' else ''}({serious}) AND {bucket} = '{b}') AS {n}_{s}_{b}" for n, w in win.items() for s in ("serious", "other") for b in ("listed", "unlisted", "unconfirmed")]
    return f"SELECT l_linestatus AS soc, l_returnflag AS pt, {', '.join(cols)} FROM lineitem JOIN {CASES} ON l_orderkey = case_id GROUP BY 1, 2"


@query(_crosstab_sql())
def soc_pt_crosstab(spark, d):
    out = safety.cross_tab(case_events(spark, d), cases(spark, d), {"interval": safety.interval(SCOPE), "cumulative": safety.cumulative(SCOPE)})
    return out.drop("interval_ids", "cumulative_ids")


@query(
    f"WITH o AS (SELECT term, count(DISTINCT case_id) AS a FROM {CASES} WHERE product = 'BUILDING' AND {IN_INTERVAL} GROUP BY 1), g AS (SELECT term, count(DISTINCT case_id) AS c FROM {CASES} WHERE product <> 'BUILDING' AND {IN_INTERVAL} GROUP BY 1), "
    "t AS (SELECT o.term, a::DOUBLE AS a, (SELECT sum(a) FROM o) - a AS b, coalesce(c, 0)::DOUBLE AS c, (SELECT sum(c) FROM g) - coalesce(c, 0) AS d FROM o LEFT JOIN g ON g.term = o.term), "
    "m AS (SELECT *, CASE WHEN c > 0 THEN (a / (a + b)) / (c / (c + d)) END AS prr, CASE WHEN b > 0 AND c > 0 AND d > 0 THEN (a * d) / (b * c) END AS ror, (a + b + c + d) * power(greatest(0, abs(a * d - b * c) - (a + b + c + d) / 2), 2) / ((a + b) * (c + d) * (a + c) * (b + d)) AS chi2 FROM t) "
    "SELECT term, a::BIGINT AS a, b::BIGINT AS b, c::BIGINT AS c, d::BIGINT AS d, round(prr, 6) AS prr, round(ror, 6) AS ror, round(chi2, 6) AS chi2, round(exp(ln(ror) - 1.959963984540054 * sqrt(1 / a + 1 / b + 1 / c + 1 / d)), 6) AS ror_low, coalesce(a >= 3 AND prr >= 2 AND chi2 >= 4, false) AS meets_evans FROM m"
)
def signal_screen(spark, d):
    c = cases(spark, d)
    out = safety.screen(c.where(safety.interval(SCOPE)), c.where(safety.background(SCOPE)))
    return out.select("term", "a", F.col("b").cast("long"), "c", F.col("d").cast("long"), *[F.round(x, 6).alias(x) for x in ("prr", "ror", "chi2", "ror_low")], "meets_evans")


@query("WITH c AS (SELECT c_custkey AS id, n_name AS country, c_mktsegment AS sex, CAST(c_acctbal / 100 AS DOUBLE) AS age FROM customer JOIN nation ON n_nationkey = c_nationkey) SELECT l.id AS a, r.id AS b, 0.4::DOUBLE AS score FROM c l JOIN c r ON l.country = r.country AND l.sex = r.sex AND l.id < r.id WHERE abs(l.age - r.age) <= 1.0")
def duplicate_pairs(spark, d):
    n = read(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("country"))
    c = read(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("case_id"), "country", F.col("c_mktsegment").alias("sex"), (F.col("c_acctbal") / 100).alias("age"))
    none = {"worldwide_case_id": "string", "local_ids": "array<string>", "qualification": "string", "receipt_date": "date", "terms": "array<string>", "onsets": "array<date>", "drugs": "array<string>"}
    out = safety.duplicate_pairs(c.withColumns({k: F.lit(None).cast(t) for k, t in none.items()}), 0.4)
    return out.select("a", "b", "score")


@query("SELECT CASE WHEN p_size % 5 = 0 THEN 'uncoded' WHEN p_brand LIKE '%1' THEN 'listed under a condition' WHEN p_brand LIKE '%2' THEN 'listed' ELSE 'no matching term' END AS basis, count(*) AS n FROM part GROUP BY 1")
def expectedness(spark, d):
    p = read(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 5 != 0, F.col("p_brand")).alias("pt"))
    brands = read(spark, d, "part").select(F.col("p_brand").alias("pt")).distinct().where(F.col("pt").rlike("[12]$"))
    terms = brands.withColumn("condition_text", F.when(F.col("pt").endswith("1"), "only at high doses"))
    return safety.expectedness(p, terms).groupBy("basis").agg(F.count("*").alias("n"))


# Laboratory


@query("SELECT CASE WHEN l_linenumber % 2 = 0 THEN CASE WHEN l_quantity <= 40 THEN 'PASS' ELSE 'FAIL' END ELSE CASE WHEN l_quantity BETWEEN 10 AND 45 THEN 'PASS' ELSE 'FAIL' END END AS outcome, count(*) AS n FROM lineitem GROUP BY 1")
def limit_verdict(spark, d):
    li = read(spark, d, "lineitem").select(
        F.concat((F.col("l_quantity").cast("int") * 1000).cast("string"), F.lit(" mg")).alias("value_text"), F.when(F.col("l_linenumber") % 2 == 0, "NMT 40 g").otherwise("10 g - 45 g").alias("_c"),
        F.when(F.col("l_linenumber") % 2 == 0, "NMT 40 g").otherwise("10 - 45 g").alias("criterion"),
    )
    return lab.conformance(li.drop("_c")).groupBy("outcome").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'nmt' WHEN 1 THEN 'range' WHEN 2 THEN 'eq' ELSE 'text' END AS operator, CASE WHEN p_size % 4 IN (0, 2) THEN p_size::DOUBLE END AS number, CASE WHEN p_size % 4 = 1 THEN p_size::DOUBLE END AS low, CASE p_size % 4 WHEN 0 THEN '%' WHEN 1 THEN 'mg/mL' WHEN 2 THEN 'ppm' END AS unit FROM part")
def value_parse(spark, d):
    n = F.col("p_size").cast("string")
    t = F.when(F.col("p_size") % 4 == 0, F.concat(F.lit("NMT "), n, F.lit(" %"))).when(F.col("p_size") % 4 == 1, F.concat(n, F.lit(" - 900 mg/mL"))).when(F.col("p_size") % 4 == 2, F.concat(n, F.lit(" ppm"))).otherwise("Complies")
    v = read(spark, d, "part").select("p_partkey", values.parse_value(t).alias("v"))
    return v.select("p_partkey", "v.operator", F.col("v.number").cast("double").alias("number"), F.col("v.low").cast("double").alias("low"), "v.unit")


@query("SELECT l_suppkey AS batch, l_returnflag AS condition, " + ", ".join(f"min(l_quantity) FILTER (month(l_shipdate) = {m}) AS m{m}" for m in (1, 3, 6, 9, 12)) + " FROM lineitem GROUP BY 1, 2")
def stability_pivot(spark, d):
    r = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("batch"), F.col("l_returnflag").alias("condition"), F.month("l_shipdate").alias("month"), "l_quantity")
    return lab.stability_pivot(r, ["batch", "condition"], "month", [1, 3, 6, 9, 12], "l_quantity")


@query("WITH r AS (SELECT DISTINCT l_partkey AS batch, l_returnflag AS condition, month(l_shipdate) AS m FROM lineitem), c AS (SELECT DISTINCT batch, condition FROM r), s AS (SELECT DISTINCT condition, m FROM r) SELECT c.batch, c.condition, count(*) AS missing FROM c JOIN s USING (condition) ANTI JOIN r ON r.batch = c.batch AND r.condition = c.condition AND r.m = s.m GROUP BY 1, 2")
def stability_holes(spark, d):
    r = read(spark, d, "lineitem").select(F.col("l_partkey").alias("batch"), F.col("l_returnflag").alias("condition"), F.month("l_shipdate").alias("month"))
    return lab.stability_holes(r, "batch", "condition", "month").select("batch", "condition", F.size("missing").cast("long").alias("missing"))


@query(
    "WITH o AS (SELECT l_orderkey AS s, l_linenumber AS t, max(l_quantity) AS v FROM lineitem GROUP BY 1, 2), r AS (SELECT *, v > lag(v) OVER (PARTITION BY s ORDER BY t) AS rise FROM o), "
    "g AS (SELECT s, count(*) AS points, bool_and(coalesce(rise, true)) AS rising, arg_min(v, t) AS first_value, arg_max(v, t) AS last_value, min(t) AS t0, max(t) AS t1 FROM r GROUP BY 1) "
    "SELECT s, points, first_value, last_value, round(t0 + (60 - first_value) / ((last_value - first_value) / (t1 - t0)), 6) AS crosses_at, t0 + (60 - first_value) / ((last_value - first_value) / (t1 - t0)) <= 2 * t1 AS flagged FROM g WHERE points >= 3 AND rising AND t1 > t0"
)
def trend_extrapolation(spark, d):
    r = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("s"), F.col("l_linenumber").alias("t")).agg(F.max("l_quantity").alias("v"))
    return lab.trends(r, ["s"], "t", "v", 60.0).select("s", "points", "first_value", "last_value", F.round("crosses_at", 6).alias("crosses_at"), "flagged")


@query("SELECT regexp_replace(lower(p_type), '[^a-z0-9]', '', 'g') AS folded, count(DISTINCT p_brand) AS brands FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1")
def spec_conflicts(spark, d):
    out = lab.spec_conflicts(read(spark, d, "part").withColumn("m", F.lit(1)), "m", "p_type", ["p_brand"])
    return out.select("folded", F.size("p_brand").cast("long").alias("brands"))


@query("WITH n AS (SELECT CASE WHEN s_suppkey % 2 = 0 THEN upper(s_name) ELSE s_name END AS name, s_nationkey FROM supplier UNION ALL SELECT s_name, s_nationkey FROM supplier) SELECT regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS folded, count(DISTINCT name) AS spellings FROM n GROUP BY 1 HAVING count(DISTINCT name) > 1")
def name_variants(spark, d):
    s = read(spark, d, "supplier")
    both = s.select(F.when(F.col("s_suppkey") % 2 == 0, F.upper("s_name")).otherwise(F.col("s_name")).alias("name")).unionByName(s.select(F.col("s_name").alias("name")))
    return lab.spelling_variants(both, "name").select("folded", F.size("spellings").cast("long").alias("spellings"))


@query("WITH f AS (SELECT l_orderkey AS g, l_linenumber AS i, l_discount AS f FROM lineitem), v AS (SELECT a.g, a.f, count(*) AS votes FROM (SELECT DISTINCT g, f FROM f) a JOIN f b ON a.g = b.g AND abs(a.f - b.f) <= 0.001 * abs(b.f) GROUP BY ALL), m AS (SELECT g, arg_max(f, votes * 1000 - f) AS modal FROM v GROUP BY 1) SELECT f.g, f.i, modal, abs(f.f - modal) <= 0.001 * abs(modal) AS agrees FROM f JOIN m ON m.g = f.g")
def modal_factor(spark, d):
    f = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("g"), F.col("l_linenumber").alias("i"), F.col("l_discount").alias("f"))
    return lab.modal_factor(f, ["g"], "i", "f").select("g", "i", "modal", "agrees")


@query("WITH a AS (SELECT l_orderkey, sum(CAST(round(CAST(l_quantity AS DECIMAL(18,4)) * CAST(l_extendedprice AS DECIMAL(18,4)), 2) AS DECIMAL(18,2))) AS s FROM lineitem GROUP BY 1), t AS (SELECT *, CAST(round(s * CAST(0.10 AS DECIMAL(6,4)), 2) AS DECIMAL(18,2)) AS x FROM a) SELECT l_orderkey, s::DOUBLE AS subtotal, x::DOUBLE AS tax, (s + x)::DOUBLE AS total FROM t")
def invoice_totals(spark, d):
    out = lab.invoice(read(spark, d, "lineitem"), ["l_orderkey"], "l_quantity", "l_extendedprice")
    return out.select("l_orderkey", *[F.col(c).cast("double").alias(c) for c in ("subtotal", "tax", "total")])


# Languages


@query("SELECT CASE WHEN o_orderkey % 7 = 0 THEN 'UNDECIDED' WHEN (o_totalprice > 150000 AND o_orderpriority IN ('1-URGENT', '2-HIGH')) OR o_orderstatus = 'P' THEN 'KEEP' ELSE 'REMOVE' END AS verdict, count(*) AS n FROM orders GROUP BY 1")
def condition_verdict(spark, d):
    o = read(spark, d, "orders").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderstatus")))
    rule = "(o_totalprice > '150,000' AND o_orderpriority in ['1-urgent', ' 2-HIGH ']) OR o_orderstatus = 'p'"
    return o.groupBy(conditions.verdict(rule, ["o_totalprice", "o_orderpriority", "o_orderstatus"]).alias("verdict")).agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_discount = 0 THEN NULL ELSE round(greatest(l_extendedprice * (1 - l_discount), 1000) / l_discount, 4) END AS value, l_discount <> 0 AS ok, CASE WHEN l_discount = 0 THEN 'division by zero' END AS error FROM lineitem")
def formula_eval(spark, d):
    f = formulas.formula("max(l_extendedprice * (1 - l_discount), 1000) / l_discount", ["l_extendedprice", "l_discount"])
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", f.alias("f")).select("l_orderkey", "l_linenumber", F.round("f.value", 4).alias("value"), "f.ok", "f.error")


# Profiles and matching


@query("SELECT 'c_custkey' AS \"column\", count(*) AS non_empty, 'number' AS observed_type FROM customer UNION ALL SELECT 'c_name', count(*), 'text' FROM customer UNION ALL SELECT 'c_acctbal', count(*), 'number' FROM customer UNION ALL SELECT 'c_mktsegment', count(*), 'text' FROM customer")
def column_profile(spark, d):
    return metrics.column_types(read(spark, d, "customer"), ["c_custkey", "c_name", "c_acctbal", "c_mktsegment"])


@query("WITH s AS (SELECT p_partkey, 1 - (1 - (p_size / 50.0) * 0.6) * (1 - (1 - exp(-p_size / 8.0)) * 0.5) * (1 - CASE WHEN p_retailprice / 2100 >= 0.75 THEN p_retailprice / 2100 ELSE 0 END * 0.4) AS s, p_brand LIKE '%5' AS vetoed, p_brand LIKE '%3' AS material FROM part) SELECT p_partkey, round(s, 6) AS score, CASE WHEN s < 0.5 THEN 'BLOCK' WHEN vetoed THEN 'REVIEW' WHEN s >= 0.97 THEN CASE WHEN material THEN 'CONFIRM' ELSE 'AUTO_ACCEPT' END WHEN s >= 0.8 THEN 'CONFIRM' ELSE 'REVIEW' END AS band FROM s")
def noisy_or_band(spark, d):
    pair = lambda s, w: F.struct(s.alias("s"), F.lit(w).alias("w"))
    s = scores.noisy_or(F.array(pair(F.col("p_size") / 50.0, 0.6), pair(scores.saturating(F.col("p_size")), 0.5), pair(scores.semantic(F.col("p_retailprice") / 2100), 0.4)))
    p = read(spark, d, "part").withColumn("s", s)
    return p.select("p_partkey", F.round("s", 6).alias("score"), scores.band(F.col("s"), F.col("p_brand").endswith("5"), F.col("p_brand").endswith("3")).alias("band"))


@query("SELECT c_custkey, 'c_name: ' || c_name || CASE WHEN c_custkey % 3 <> 0 THEN '; c_mktsegment: ' || c_mktsegment ELSE '' END AS chunk FROM customer")
def record_chunks(spark, d):
    c = read(spark, d, "customer").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")))
    return c.select("c_custkey", text.record_text(["c_name", "c_mktsegment"]).alias("chunk"))


@query("SELECT event_type, props, count(DISTINCT user_id % 10) AS tenants, round(sum(value), 4) AS weight FROM events GROUP BY 1, 2 HAVING count(DISTINCT user_id % 10) >= 3")
def k_anonymous_patterns(spark, d):
    e = events(spark, d)
    return metrics.k_anonymous(e, ["event_type", "props"], "org", "value").withColumn("weight", F.round("weight", 4))


@query("SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS ordered FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 100")
def offset_page(spark, d):
    o = read(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select("o_orderkey", "o_orderdate")
    return usage.offset_page(o, [F.desc("o_orderdate"), "o_orderkey"], 50, 100).select("o_orderkey", day(F.col("o_orderdate")).alias("ordered"))


# Text

TOKENS_SQL = "list_filter(regexp_extract_all(lower(text), '[a-z0-9]+(?:[./\\-][a-z0-9]+)*'), lambda t: NOT list_contains([" + ", ".join(f"'{w}'" for w in text.STOPWORDS) + "], t))"
ASK = "licensed work public license heed onesen"


@query(
    f"WITH d AS (SELECT doc_id AS id, unnest({TOKENS_SQL}) AS term FROM documents), t AS (SELECT id, term, count(*) AS tf FROM d GROUP BY 1, 2), n AS (SELECT count(*) AS n FROM documents), i AS (SELECT term, ln((1.0 + n) / (1.0 + count(*))) + 1 AS idf FROM t, n GROUP BY term, n), "
    f"w AS (SELECT id, term, tf * idf AS w FROM t JOIN i USING (term)), q AS (SELECT term, count(*) * idf AS qw FROM (SELECT unnest(string_split('{ASK}', ' ')) AS term) JOIN i USING (term) GROUP BY term, idf), qn AS (SELECT sqrt(sum(qw * qw)) AS qn FROM q), nn AS (SELECT id, sqrt(sum(w * w)) AS norm FROM w GROUP BY 1) "
    "SELECT w.id, round(sum(w * qw) / (norm * qn), 6) AS score FROM w JOIN q USING (term) JOIN nn USING (id), qn GROUP BY w.id, norm, qn"
)
def tfidf_rank(spark, d):
    return retrieval.tfidf_scores(read(spark, d, "documents"), ASK, "doc_id", "text").withColumn("score", F.round("score", 6))


@query("WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 7) SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], q), 8) AS score FROM embeddings, q ORDER BY list_cosine_similarity(embedding::DOUBLE[], q) DESC, vec_id LIMIT 20")
def cosine_topk(spark, d):
    e = read(spark, d, "embeddings")
    asked = e.where("vec_id = 7").select("embedding").first()[0]
    return retrieval.cosine_top_k(e, list(asked), 20, "vec_id", "embedding").select("id", F.round("score", 8).alias("score"))


@query()
def hybrid_rank(spark, d):
    """Lexical scores of all documents and cosines of all vectors in one list. `hybrid_scores` has SQL for the fusion."""
    e = read(spark, d, "embeddings")
    asked = e.where("vec_id = 7").select("embedding").first()[0]
    vec = e.select(F.col("vec_id").alias("id"), scores.cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in asked])).alias("score"))
    return retrieval.fuse(retrieval.tfidf_scores(read(spark, d, "documents"), ASK, "doc_id", "text"), vec, 30)


@query("SELECT source, doc_id FROM (SELECT source, doc_id, sum(length(text)) OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id ROWS UNBOUNDED PRECEDING) AS used FROM documents) WHERE used <= 40000")
def char_budget(spark, d):
    x = read(spark, d, "documents").select("source", "doc_id", "n_chars", "text")
    return usage.char_budget(x, [F.desc("n_chars"), "doc_id"], "text", 40000, ["source"]).select("source", "doc_id")


@query("SELECT sha256(text) AS digest, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def content_dedupe(spark, d):
    x = read(spark, d, "documents").select("doc_id", text.content_sha256(F.col("text")).alias("digest"))
    return x.groupBy("digest").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


@query("SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9_][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)*\\.[A-Za-z]{2,}'))::BIGINT AS emails FROM documents WHERE len(regexp_extract_all(text, '[A-Za-z0-9_][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)*\\.[A-Za-z]{2,}')) > 0")
def pii_scan(spark, d):
    """E-mail addresses among all that detection finds in the whole documents."""
    x = privacy.leaks(read(spark, d, "documents").select("doc_id", "text"), "text")
    n = F.size(F.filter("spans", lambda s: s["kind"] == "email")).cast("long")
    return x.select("doc_id", n.alias("emails")).where("emails > 0")


@query(
    r"WITH t AS (SELECT doc_id, string_split_regex(text, '[ \t\n\x0B\f\r]+') AS ws FROM documents), p AS (SELECT doc_id, unnest(ws[:-2]) AS a, unnest(ws[2:]) AS b FROM t WHERE len(ws) > 1), "
    r"e AS (SELECT doc_id, lower(regexp_extract(a, '(?:^|[^\p{L}\p{N}_])([A-Za-z0-9_]+)$', 1)) AS word, lower(b) AS b FROM p) "
    r"SELECT word, count(DISTINCT doc_id) AS documents FROM e WHERE word <> '' AND starts_with(b, word) AND NOT regexp_matches(substr(b, length(word) + 1, 1), '[\p{L}\p{N}_]') GROUP BY 1"
)
def doubled_words(spark, d):
    x = read(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(text.doubled_words(F.col("text")))).alias("word"))
    return x.groupBy("word").agg(F.count("*").alias("documents"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) WHEN o_orderkey % 3 = 1 AND day(o_orderdate) > 12 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) WHEN o_orderkey % 3 = 2 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS value, CASE WHEN o_orderkey % 3 = 1 AND day(o_orderdate) <= 12 THEN 'ambiguous' END AS reason FROM orders")
def date_parse(spark, d):
    o = read(spark, d, "orders")
    c = F.col("o_orderdate")
    t = F.when(F.col("o_orderkey") % 3 == 0, F.date_format(c, "yyyyMMdd")).when(F.col("o_orderkey") % 3 == 1, F.date_format(c, "dd/MM/yyyy")).otherwise(F.date_format(c, "d-MMM-yy"))
    return o.select("o_orderkey", dates.parse_ordered(t).alias("p")).select("o_orderkey", day(F.col("p.value")).alias("value"), "p.reason")
