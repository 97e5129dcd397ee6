"""Queries of periodic safety reports: tables, checks and audit. Signals, actions and sections are made of part, supplier and nation."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from tabloom.operators import lab, metrics, safety, safety_checks, text_checks, usage
from tabloom.plans.catalogue import CASES, IN_INTERVAL, ORACLE_SQL, QUERIES, SCOPE, case_events, cases, day, query, read
from tabloom.plans.texts import say

START, END, LOCK = date(2024, 2, 10), date(2024, 3, 10), date(2024, 2, 5)
LATE_SQL = "DATE '2024-02-10' AND DATE '2024-03-10'"


def signals(spark, d):
    n, k = F.col("p_size"), F.col("p_partkey")
    status = F.element_at(F.array(*[F.lit(s) for s in ("candidate", "new", "ongoing", "closed", "refuted", None)]), (k % 6 + 1).cast("int"))
    start = F.lit("2024-01-01").cast("date")
    return read(spark, d, "part").select(
        k.alias("signal_id"), status.alias("status"), F.when(n % 4 != 0, "done").alias("conclusion"), F.date_add(start, n).alias("detected_on"), F.date_add(F.lit("2024-02-01").cast("date"), n).alias("closed_on"), F.when(n % 3 != 0, "review").alias("source"),
    )


SIGNALS = (
    "(SELECT p_partkey AS signal_id, ['candidate', 'new', 'ongoing', 'closed', 'refuted', NULL][CAST(p_partkey % 6 AS INTEGER) + 1] AS status, CASE WHEN p_size % 4 <> 0 THEN 'done' END AS conclusion, DATE '2024-01-01' + p_size AS detected_on, "
    "DATE '2024-02-01' + p_size AS closed_on, CASE WHEN p_size % 3 <> 0 THEN 'review' END AS source FROM part) s"
)


# Tables


@query(f"SELECT signal_id, status FROM {SIGNALS} WHERE (status IN ('new', 'ongoing') OR (status = 'closed' AND closed_on BETWEEN {LATE_SQL})) AND detected_on <= DATE '2024-02-05'")
def signals_shown(spark, d):
    return safety_checks.signals_in_report(signals(spark, d), START, END, LOCK).select("signal_id", "status")


@query(f"SELECT signal_id, CAST(detected_on AS VARCHAR) AS detected_on, concat_ws(', ', CASE WHEN source IS NULL THEN 'source' END, CASE WHEN conclusion IS NULL THEN 'conclusion' END) AS missing, row_number() OVER (ORDER BY s.detected_on, signal_id) AS place FROM {SIGNALS}")
def signal_overview(spark, d):
    return usage.numbered(safety_checks.signal_overview(signals(spark, d))).select("signal_id", day(F.col("detected_on")).alias("detected_on"), "missing", "place")


@query("SELECT context, region, patients, CASE WHEN patients IS NULL THEN 'no estimate' END AS note, row_number() OVER (ORDER BY context, region, patients NULLS FIRST) AS place FROM (SELECT CASE WHEN c_custkey % 2 = 0 THEN 'market' ELSE 'trial' END AS context, c_nationkey AS region, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey END AS patients FROM customer)")
def exposure_rows(spark, d):
    k = F.col("c_custkey")
    x = read(spark, d, "customer").select(F.when(k % 2 == 0, "market").otherwise("trial").alias("context"), F.col("c_nationkey").alias("region"), F.when(k % 3 != 0, k).alias("patients"))
    return usage.numbered(safety_checks.exposure_table(x))


@query("SELECT category, concern, row_number() OVER (ORDER BY CASE lower(category) WHEN 'important identified risk' THEN 1 WHEN 'important potential risk' THEN 2 WHEN 'missing information' THEN 3 ELSE 4 END, lower(concern)) AS place FROM (SELECT ['Important potential risk', 'missing information', 'important identified risk', 'other'][n_nationkey % 4 + 1] AS category, n_name AS concern FROM nation)")
def concern_rows(spark, d):
    c = F.element_at(F.array(*[F.lit(x) for x in ("Important potential risk", "missing information", "important identified risk", "other")]), F.col("n_nationkey") % 4 + 1)
    return usage.numbered(safety_checks.concern_table(read(spark, d, "nation").select(c.alias("category"), F.col("n_name").alias("concern"))))


def actions(spark, d):
    k = F.col("p_partkey")
    return read(spark, d, "part").select(k.alias("id"), F.when(k % 3 == 0, "label_change").otherwise("letter").alias("kind"), F.when(k % 7 != 0, F.date_add(F.lit("2024-02-01").cast("date"), F.col("p_size"))).alias("action_date"))


ACTIONS = "(SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'label_change' ELSE 'letter' END AS kind, CASE WHEN p_partkey % 7 <> 0 THEN DATE '2024-02-01' + p_size END AS action_date FROM part) a"


@query(f"SELECT id, kind, CAST(action_date AS VARCHAR) AS action_date, action_date IS NULL AS undated FROM {ACTIONS} WHERE action_date IS NULL OR action_date BETWEEN {LATE_SQL}")
def action_rows(spark, d):
    return safety_checks.action_table(actions(spark, d), START, END).select("id", "kind", day(F.col("action_date")).alias("action_date"), "undated")


@query("SELECT country, approved_on, row_number() OVER (ORDER BY country, approved_on NULLS LAST) AS place FROM (SELECT n_name AS country, CASE WHEN s_suppkey % 4 <> 0 THEN s_suppkey END AS approved_on FROM supplier JOIN nation ON n_nationkey = s_nationkey)")
def approval_rows(spark, d):
    n = read(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("country"))
    s = read(spark, d, "supplier").join(n, "s_nationkey").select("country", F.when(F.col("s_suppkey") % 4 != 0, F.col("s_suppkey")).alias("approved_on"))
    return usage.numbered(safety_checks.approvals(s))


@query(f"SELECT id, linked FROM (SELECT p_partkey AS id, CASE WHEN p_partkey % 5 <> 0 THEN DATE '2024-02-01' + p_size END AS published, CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 0 END::BIGINT AS linked FROM part) WHERE published IS NULL OR published BETWEEN {LATE_SQL}")
def literature_rows(spark, d):
    k = F.col("p_partkey")
    refs = read(spark, d, "part").select(k.alias("id"), F.col("p_name").alias("title"), F.when(k % 5 != 0, F.date_add(F.lit("2024-02-01").cast("date"), F.col("p_size"))).alias("published"), F.when(k % 2 == 0, F.array(F.lit("a"), F.lit("b"))).alias("case_ids"))
    return safety_checks.literature(refs, START, END).select("id", F.col("linked").cast("long").alias("linked"))


@query("SELECT p_type AS soc, p_brand AS pt, p_partkey AS id, row_number() OVER (ORDER BY lower(p_type), lower(p_brand), p_type, p_brand, p_partkey) AS place FROM part")
def listed_terms(spark, d):
    return usage.numbered(safety_checks.listed_terms(read(spark, d, "part").select(F.col("p_type").alias("soc"), F.col("p_brand").alias("pt"), F.col("p_partkey").alias("id"))))


@query(f"WITH o AS (SELECT term, count(DISTINCT case_id) AS a FROM {CASES} WHERE product = 'BUILDING' AND {IN_INTERVAL} GROUP BY 1), g AS (SELECT term, count(DISTINCT case_id) AS c FROM {CASES} WHERE product <> 'BUILDING' AND {IN_INTERVAL} GROUP BY 1), t AS (SELECT o.term, a::DOUBLE AS a, (SELECT sum(a) FROM o) - a AS b, coalesce(c, 0)::DOUBLE AS c, (SELECT sum(c) FROM g) - coalesce(c, 0) AS d FROM o LEFT JOIN g ON g.term = o.term), m AS (SELECT *, CASE WHEN c > 0 THEN (a / (a + b)) / (c / (c + d)) END AS prr, (a + b + c + d) * power(greatest(0, abs(a * d - b * c) - (a + b + c + d) / 2), 2) / ((a + b) * (c + d) * (a + c) * (b + d)) AS chi2, exp(ln((a * d) / (b * c)) - 1.959963984540054 * sqrt(1 / a + 1 / b + 1 / c + 1 / d)) AS low FROM t) SELECT term, a::BIGINT AS a, row_number() OVER (ORDER BY coalesce((a >= 3 AND prr >= 2 AND chi2 >= 4) OR (a >= 3 AND low > 1), false) DESC, coalesce(prr, 0) DESC, a DESC, term) AS place FROM m")
def screening_order(spark, d):
    c = cases(spark, d)
    return usage.numbered(safety.screen(c.where(safety.interval(SCOPE)), c.where(safety.background(SCOPE)))).select("term", "a", "place")


# Counts behind the checks


@query("SELECT CASE WHEN l_linenumber % 3 = 0 OR l_quantity % 2 = 0 THEN true WHEN l_linenumber % 3 = 1 OR l_quantity % 2 = 1 THEN false END AS related, count(*) AS n FROM lineitem GROUP BY 1")
def related_events(spark, d):
    n, q = F.col("l_linenumber"), F.col("l_quantity")
    company, reporter = F.when(n % 3 == 0, "Related").when(n % 3 == 1, "unrelated"), F.when(q % 2 == 0, " possible ").when(q % 2 == 1, "not related")
    return read(spark, d, "lineitem").groupBy(safety.is_related(company, reporter).alias("related")).agg(F.count("*").alias("n"))


SERIOUS = "CASE WHEN l_linenumber <= 4 THEN l_discount > 0.05 ELSE l_discount > 0.05 OR serious END"


@query(f"SELECT count(*) AS n FROM lineitem JOIN {CASES} ON l_orderkey = case_id WHERE product = 'BUILDING' AND {IN_INTERVAL} AND ({SERIOUS}) AND l_linenumber % 3 <> 0 AND l_quantity % 2 = 1")
def serious_unrelated(spark, d):
    li = read(spark, d, "lineitem")
    n, q = F.col("l_linenumber"), F.col("l_quantity")
    e = li.select(F.col("l_orderkey").alias("case_id"), (F.col("l_discount") > 0.05).alias("event_serious"), F.when(n <= 4, "u").alias("confirmed_by"), F.when(n % 3 == 0, "related").when(n % 3 == 1, "unrelated").alias("company"), F.when(q % 2 == 0, "possible").when(q % 2 == 1, "not related").alias("reporter"))
    return safety.serious_unrelated(e, cases(spark, d), safety.interval(SCOPE))


@query(f"SELECT l_linestatus AS soc, l_returnflag AS pt, count(*) AS events, count(DISTINCT l_orderkey) AS cases FROM lineitem JOIN {CASES} ON l_orderkey = case_id WHERE case_id % 4 = 0 AND product = 'BUILDING' AND vd <= DATE '1995-07-15' AND rd >= DATE '1994-01-01' AND ({SERIOUS}) GROUP BY 1, 2")
def trial_events(spark, d):
    c = cases(spark, d).withColumn("source", F.when(F.col("case_id") % 4 == 0, "clinical_trial").otherwise("spontaneous"))
    return safety.trial_saes(case_events(spark, d), c, safety.cumulative(SCOPE))


@query("SELECT version_id, listed, row_number() OVER (ORDER BY effective DESC NULLS LAST, version_id) AS place FROM (SELECT s_suppkey AS version_id, CASE WHEN s_suppkey % 4 <> 0 THEN DATE '2020-01-01' + CAST(s_suppkey % 50 AS INTEGER) END AS effective, (SELECT count(*) FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 45) AS listed FROM supplier)")
def rsi_versions(spark, d):
    k = F.col("s_suppkey")
    v = read(spark, d, "supplier").select(k.alias("version_id"), F.when(k % 4 != 0, F.date_add(F.lit("2020-01-01").cast("date"), (k % 50).cast("int"))).alias("effective"))
    terms = read(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_suppkey").alias("version_id"))
    return usage.numbered(safety.rsi_versions(v, terms)).select("version_id", "listed", "place")


@query("SELECT event_id FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_nationkey = 1) OR user_id IN (SELECT s_suppkey FROM supplier WHERE s_nationkey = 2)")
def report_audit(spark, d):
    log = read(spark, d, "events").select("event_id", F.col("user_id").alias("entity_id"))
    return safety.report_audit(log, read(spark, d, "customer").where("c_nationkey = 1").select("c_custkey"), read(spark, d, "supplier").where("s_nationkey = 2").select("s_suppkey")).select("event_id")


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def bulk_targets(spark, d):
    return safety.bulk_targets(read(spark, d, "orders"), " 1-Urgent ", "o_orderpriority").select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 5 = 0")
def skipped_listing_rows(spark, d):
    rows = read(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_custkey").cast("string")).otherwise("  ").alias("case_id"))
    return safety.skipped_rows(rows, "case_id").select("o_orderkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_shipdate <= DATE '1995-06-30' AND (l_linenumber % 2 = 0 OR l_shipdate + INTERVAL 30 DAY >= DATE '1995-01-01')")
def treated_in_period(spark, d):
    li = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_shipdate").cast("date").alias("a"), F.when(F.col("l_linenumber") % 2 == 1, F.date_add(F.col("l_shipdate").cast("date"), 30)).alias("b"))
    return li.where(safety.overlaps_period(F.col("a"), F.col("b"), date(1995, 1, 1), date(1995, 6, 30))).select("l_orderkey", "l_linenumber")


@query("SELECT a, b FROM (SELECT x.s_suppkey AS a, y.s_suppkey AS b FROM supplier x JOIN supplier y ON x.s_nationkey = y.s_nationkey AND x.s_suppkey < y.s_suppkey) WHERE (a + b) % 3 <> 0")
def new_duplicate_pairs(spark, d):
    s = read(spark, d, "supplier")
    p = s.select(F.col("s_suppkey").alias("a"), "s_nationkey").join(s.select(F.col("s_suppkey").alias("b"), "s_nationkey"), "s_nationkey").where("a < b").select("a", "b")
    return safety.new_pairs(p, p.where("(a + b) % 3 = 0"))


@query(
    "WITH c AS (SELECT c_custkey AS id, 'W' || (c_custkey % 40) AS world, n_name AS country, c_mktsegment AS sex, c_acctbal / 100 AS age, ['doctor', 'nurse', 'lawyer'][CAST(c_custkey % 3 AS INTEGER) + 1] AS q, DATE '2024-01-01' + CAST(c_custkey % 11 AS INTEGER) AS r, 't' || (c_custkey % 7) AS t, 'd' || (c_custkey % 5) AS drug, DATE '2024-01-01' + CAST(c_custkey % 13 AS INTEGER) AS o, 'l' || (c_custkey % 90) AS loc FROM customer JOIN nation ON n_nationkey = c_nationkey), "
    "p AS (SELECT l.id AS a, r.id AS b, [l.world = r.world, l.loc = r.loc, l.o = r.o, l.r = r.r, l.t = r.t, l.country = r.country, l.sex = r.sex, abs(l.age - r.age) <= 1.0, l.q = r.q, l.drug = r.drug] AS m FROM c l JOIN c r ON l.id < r.id AND ((l.country = r.country AND l.sex = r.sex) OR l.world = r.world OR l.loc = r.loc)), "
    "s AS (SELECT a, b, list_sum(list_transform(range(1, 11), lambda i: CASE WHEN m[i] THEN [1.0, 0.7, 0.35, 0.2, 0.3, 0.1, 0.1, 0.2, 0.05, 0.1][i] ELSE 0 END)) AS score, len(list_filter(m, lambda x: x)) AS n FROM p) SELECT a, b, round(score, 3)::DOUBLE AS score, n::BIGINT AS fields FROM s WHERE round(score, 3) >= 0.6 AND n >= 2"
)
def duplicate_pairs_all_fields(spark, d):
    k = F.col("c_custkey")
    n = read(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("country"))
    on = lambda m: F.date_add(F.lit("2024-01-01").cast("date"), (k % m).cast("int"))
    c = read(spark, d, "customer").join(n, "c_nationkey").select(
        k.alias("case_id"), say("W", k % 40).alias("worldwide_case_id"), F.array(say("l", k % 90)).alias("local_ids"), "country", F.col("c_mktsegment").alias("sex"), (F.col("c_acctbal") / 100).alias("age"),
        F.element_at(F.array(F.lit("doctor"), F.lit("nurse"), F.lit("lawyer")), (k % 3 + 1).cast("int")).alias("qualification"), on(11).alias("receipt_date"), F.array(say("t", k % 7)).alias("terms"), F.array(on(13)).alias("onsets"), F.array(say("d", k % 5)).alias("drugs"),
    )
    return safety.duplicate_pairs(c).select("a", "b", "score", F.size("matched_on").cast("long").alias("fields"))


# Findings


def said(df):
    return df.select("code", "severity", "message")


@query("SELECT 'RECONCILIATION' AS code, 'blocker' AS severity, 'summary ' || s || ', listed ' || l || ', unassessed ' || u || ', unrelated ' || r AS message FROM (SELECT l_suppkey, count(*) AS s, count(*) FILTER (l_linenumber % 3 = 0) AS l, count(*) FILTER (l_linenumber % 3 = 1) AS u, count(*) FILTER (l_linenumber % 3 = 2 AND l_quantity < 50) AS r FROM lineitem GROUP BY 1) WHERE s <> l + u + r")
def check_reconciliation(spark, d):
    n = F.col("l_linenumber") % 3
    c = read(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("summary"), F.count_if(n == 0).alias("listed"), F.count_if(n == 1).alias("unassessed"), F.count_if((n == 2) & (F.col("l_quantity") < 50)).alias("unrelated"))
    return said(safety_checks.reconciliation(c))


def intervals(spark, d):
    g = read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("product"), F.year("l_shipdate").alias("sequence")).agg(F.count("*").alias("interval"))
    return g.withColumn("cumulative", F.col("interval") * F.when(F.col("sequence") % 3 == 0, 0).otherwise(F.col("sequence") - 1990))


INTERVALS = "(SELECT *, n * CASE WHEN sequence % 3 = 0 THEN 0 ELSE sequence - 1990 END AS cumulative, lag(n) OVER (PARTITION BY product ORDER BY sequence) AS before, lag(n * CASE WHEN sequence % 3 = 0 THEN 0 ELSE sequence - 1990 END) OVER (PARTITION BY product ORDER BY sequence) AS last FROM (SELECT l_suppkey AS product, year(l_shipdate) AS sequence, count(*) AS n FROM lineitem GROUP BY 1, 2)) i"


@query(f"SELECT 'CUMULATIVE_BELOW_INTERVAL' AS code, 'blocker' AS severity, 'report ' || sequence AS message FROM {INTERVALS} WHERE cumulative < n UNION ALL SELECT 'CUMULATIVE_FELL', 'blocker', 'report ' || sequence FROM {INTERVALS} WHERE cumulative < last")
def check_windows(spark, d):
    return said(safety_checks.window_sanity(intervals(spark, d)))


@query(f"SELECT product, sequence::INTEGER AS sequence, before, round((n - before) / before::DOUBLE, 8) AS change FROM {INTERVALS}")
def volume_trend(spark, d):
    return safety_checks.volume_trend(intervals(spark, d)).select("product", "sequence", "before", F.round("change", 8).alias("change"))


@query("SELECT 'DICTIONARY_VERSION' AS code, 'warning' AS severity, (SELECT string_agg(v, ', ' ORDER BY v) FROM (SELECT DISTINCT l_returnflag AS v FROM lineitem)) AS message")
def check_dictionary(spark, d):
    return said(safety_checks.one_dictionary(read(spark, d, "lineitem"), "N", "l_returnflag"))


@query(f"SELECT 'UNCODED_EVENTS' AS code, 'blocker' AS severity, count(*)::VARCHAR AS message FROM lineitem JOIN {CASES} ON l_orderkey = case_id WHERE product = 'BUILDING' AND {IN_INTERVAL} AND l_returnflag = 'R' HAVING count(*) > 0")
def check_uncoded(spark, d):
    e = case_events(spark, d).withColumn("coding_required", F.col("pt") == "R")
    return said(safety_checks.uncoded(e, cases(spark, d).where(safety.interval(SCOPE))))


@query("SELECT 'NARRATIVE_MISSING' AS code, 'warning' AS severity, o_orderkey::VARCHAR AS message FROM orders WHERE (o_orderstatus = 'P' OR o_orderpriority = '1-URGENT') AND o_orderkey % 4 <> 0")
def check_narratives(spark, d):
    c = read(spark, d, "orders").select(F.col("o_orderkey").alias("case_id"), F.when(F.col("o_orderstatus") == "P", F.array(F.lit("death"))).otherwise(F.array(F.lit("hospital"))).alias("seriousness_criteria"), F.array("o_orderpriority").alias("terms"))
    return said(safety_checks.narratives_missing(c, c.where("case_id % 4 = 0"), ["1-URGENT"]))


@query("SELECT 'RSI_VERSION' AS code, 'warning' AS severity, (l_orderkey * 10 + l_linenumber)::VARCHAR AS message FROM lineitem WHERE l_linenumber <= 4 AND l_returnflag <> 'N'")
def check_rsi_version(spark, d):
    return said(safety_checks.stale_expectedness(case_events(spark, d).withColumn("rsi_version", F.col("pt")), "N"))


@query(f"SELECT 'SIGNAL_NO_STATUS' AS code, 'blocker' AS severity, signal_id::VARCHAR AS message FROM {SIGNALS} WHERE status IS NULL UNION ALL SELECT 'SIGNAL_CLOSED_INCOMPLETE', 'warning', signal_id::VARCHAR FROM {SIGNALS} WHERE status = 'closed' AND conclusion IS NULL UNION ALL SELECT 'SIGNAL_UNTRIAGED', 'warning', signal_id::VARCHAR FROM {SIGNALS} WHERE status = 'candidate' AND detected_on <= DATE '2024-02-05'")
def check_signals(spark, d):
    return said(safety_checks.signal_hygiene(signals(spark, d), LOCK))


@query(f"SELECT 'LABEL_CHANGE' AS code, 'warning' AS severity, CAST(action_date AS VARCHAR) AS message FROM {ACTIONS} WHERE kind = 'label_change' AND action_date > (SELECT max(DATE '2024-02-01' + CAST(s_suppkey % 20 AS INTEGER)) FROM supplier)")
def check_label_change(spark, d):
    v = read(spark, d, "supplier").select(F.date_add(F.lit("2024-02-01").cast("date"), (F.col("s_suppkey") % 20).cast("int")).alias("effective"))
    return said(safety_checks.label_continuity(actions(spark, d), v))


def sections(spark, d):
    k = F.col("n_nationkey")
    content = F.when(k % 4 == 0, "Reporting rate was 3 per 1,000 patients.").when(k % 4 == 1, say("There were 12 cases and ", k, " more. [TABLE: 1] [TABLE: x] [DATA NEEDED: dose]")).when(k % 4 == 2, "[ASSESSMENT REQUIRED: now]").otherwise(" ")
    return read(spark, d, "nation").select(F.col("n_name").alias("section"), content.alias("content"), (k % 2 == 0).alias("carried"), (k % 3 != 0).alias("enabled"), F.when(k % 5 != 0, "u").alias("approved_by"))


@query("SELECT 'RATE_WITHOUT_DENOMINATOR' AS code, 'blocker' AS severity, n_name AS message FROM nation WHERE n_nationkey % 4 = 0")
def check_rates(spark, d):
    return said(safety_checks.rates_without_exposure(sections(spark, d), read(spark, d, "region").select(F.lit(False).alias("confirmed"))))


@query("SELECT n_name AS section, '12' AS figure FROM nation WHERE n_nationkey % 4 = 1 UNION SELECT n_name, n_nationkey::VARCHAR FROM nation WHERE n_nationkey % 4 = 1 AND n_nationkey NOT IN (1, 5) UNION SELECT n_name, unnest(['3', '1000']) FROM nation WHERE n_nationkey % 4 = 0 UNION SELECT n_name, '1' FROM nation WHERE false")
def check_figures(spark, d):
    cells = read(spark, d, "region").limit(1).select(F.array(F.lit("1"), F.lit("5"), F.lit("x")).alias("cells"))
    return safety_checks.unsourced_figures(sections(spark, d), cells).select("section", "figure")


@query("SELECT 'TABLE_UNKNOWN' AS code, 'blocker' AS severity, 'x' AS message FROM nation WHERE n_nationkey % 4 = 1 UNION ALL SELECT 'DATA_NEEDED', 'blocker', 'dose' FROM nation WHERE n_nationkey % 4 = 1 UNION ALL SELECT 'ASSESSMENT_REQUIRED', 'blocker', n_name FROM nation WHERE n_nationkey % 4 = 2")
def check_markers(spark, d):
    return said(safety_checks.markers(sections(spark, d), ["1"]))


@query(f"SELECT 'BOUND_CASE' AS code, 'blocker' AS severity, k || ' ' || CASE WHEN case_id IS NULL THEN 'missing' WHEN rd IS NULL THEN 'undated' ELSE 'after_lock' END AS message FROM (SELECT o_orderkey * 2 AS k FROM orders) b LEFT JOIN {CASES} ON k = case_id WHERE case_id IS NULL OR rd IS NULL OR vd > DATE '1995-07-15'")
def check_bound_cases(spark, d):
    b = read(spark, d, "orders").select((F.col("o_orderkey") * 2).alias("case_id"))
    return said(safety_checks.bound_cases(b, cases(spark, d), safety.window_label(SCOPE)))


@query("SELECT 'FIGURE_CHANGED' AS code, 'warning' AS severity, n_name AS message FROM nation WHERE n_nationkey % 6 = 0 UNION ALL SELECT 'FIGURE_CHANGED', 'warning', 'new'")
def check_figure_drift(spark, d):
    n = read(spark, d, "nation").select(F.col("n_name").alias("key"), F.col("n_nationkey").cast("long").alias("value"))
    now = n.withColumn("value", F.when(F.col("value") % 6 != 0, F.col("value"))).unionByName(read(spark, d, "region").limit(1).select(F.lit("new").alias("key"), F.lit(1).cast("long").alias("value")))
    now = now.withColumn("value", F.when((F.col("key") != "new") & F.col("value").isNull(), -1).otherwise(F.col("value")))
    return said(safety_checks.figure_drift(n, now))


@query("SELECT 'n:' || r_regionkey AS key, r_regionkey::BIGINT AS value FROM region UNION ALL SELECT 'total:' || n_regionkey, sum(n_nationkey)::BIGINT FROM nation GROUP BY 1")
def stated_figures(spark, d):
    counts = read(spark, d, "region").select(say("n:", "$r_regionkey").alias("key"), F.col("r_regionkey").alias("value"))
    tables = read(spark, d, "nation").select(F.col("n_regionkey").cast("string").alias("table"), F.array(F.col("n_nationkey").cast("string"), F.lit("n/a")).alias("cells"))
    return safety_checks.stated_figures(counts, tables)


@query("SELECT 'BASELINE_FIGURE_CARRIED' AS code, 'warning' AS severity, n_name || ' 3, 1,000' AS message FROM nation WHERE n_nationkey % 4 = 0")
def check_carried(spark, d):
    return said(safety_checks.carried_figures(sections(spark, d)))


@query("SELECT 'SECTION_NOT_APPROVED' AS code, 'blocker' AS severity, n_name AS message FROM nation WHERE n_nationkey % 3 <> 0 AND n_nationkey % 5 = 0 UNION ALL SELECT 'SECTION_EMPTY', 'blocker', n_name FROM nation WHERE n_nationkey % 3 <> 0 AND n_nationkey % 4 = 3")
def check_approval(spark, d):
    return said(safety_checks.unapproved(sections(spark, d)))


@query("SELECT 'REGION_DUE' AS code, 'warning' AS severity, 'r' || n_regionkey AS message FROM nation WHERE n_nationkey % 2 = 0")
def check_regions(spark, d):
    n = read(spark, d, "nation")
    own = say("r", "$n_regionkey")
    return said(safety_checks.regions_due(n.select(F.array(F.lit("eu"), own).alias("targets"), F.when(F.col("n_nationkey") % 2 == 0, F.array(F.lit("eu"))).otherwise(F.array(F.lit("eu"), own)).alias("recorded"))))


@query(f"SELECT 'UNCONFIRMED_DATA' AS code, 'blocker' AS severity, count(*) || ' A, B' AS message FROM lineitem JOIN {CASES} ON l_orderkey = case_id WHERE product = 'BUILDING' AND {IN_INTERVAL} AND l_linenumber > 4 HAVING count(*) > 0")
def check_unconfirmed(spark, d):
    return said(safety_checks.unconfirmed(case_events(spark, d), cases(spark, d).where(safety.interval(SCOPE)), ["A", "B"]))


#: The checks of a report, in the order of its list.
CHECKS = (
    "reconciliation", "windows", "dictionary", "uncoded", "narratives", "rsi_version", "signals", "label_change", "rates", "markers", "bound_cases", "carried", "approval", "regions", "unconfirmed",
)
EVERY_FINDING = " UNION ALL ".join(f"SELECT code, severity, message FROM ({ORACLE_SQL[f'check_{n}']})" for n in CHECKS)
EVERY_FINDING += f" UNION ALL SELECT 'FIGURE_UNSOURCED', 'warning', section || ' ' || figure FROM ({ORACLE_SQL['check_figures']})"


@query(
    "SELECT code, CASE WHEN severity = 'blocker' AND code = 'SECTION_NOT_APPROVED' AND message IN (SELECT n_name FROM nation WHERE n_nationkey = 5) THEN 'warning' ELSE severity END AS severity, message "
    f"FROM ({EVERY_FINDING} UNION ALL SELECT 'QC_CHECK_FAILED', 'blocker', 'broken: ZeroDivisionError')"
)
def safety_quality_run(spark, d):
    """All checks of a report in one run: one more cannot be planned, and one finding was accepted."""

    def broken():
        return spark.range(1 // 0)

    accepted = read(spark, d, "nation").where("n_nationkey = 5").select(F.lit("SECTION_NOT_APPROVED").alias("code"), F.col("n_name").alias("message"))
    checks = {n: (lambda n=n: QUERIES[f"check_{n}"](spark, d)) for n in CHECKS} | {"broken": broken, "figures": lambda: lab.finding(check_figures(spark, d), "FIGURE_UNSOURCED", "warning", F.concat_ws(" ", "section", "figure"))}
    return safety_checks.quality_run(checks, accepted)


# Counters


@query("SELECT event_type AS kind, count(*) AS n, count(*) FILTER (user_id % 3 <> 0) AS verified, count(*) FILTER (value > 15) AS conflicts FROM events GROUP BY 1")
def verification_counts(spark, d):
    from tabloom.operators import lab

    e = read(spark, d, "events").select(F.col("event_type").alias("kind"), F.when(F.col("user_id") % 3 != 0, "u").alias("verified_by"), (F.col("value") > 15).alias("conflict"))
    return lab.verification_summary(e, ["kind"], "verified_by", "conflict")


@query("SELECT o_custkey AS job, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS generated, count(*) FILTER (o_orderstatus = 'O') AS pending, count(*) FILTER (o_orderstatus = 'P') AS failed, count(*) FILTER (o_orderstatus <> 'O') AS done FROM orders GROUP BY 1")
def run_progress(spark, d):
    s = F.when(F.col("o_orderstatus") == "F", "generated").when(F.col("o_orderstatus") == "O", "pending").otherwise("failed")
    return usage.progress(read(spark, d, "orders").select(F.col("o_custkey").alias("job"), s.alias("status")), "job", "status", ["generated", "pending", "failed"])


@query("SELECT c_mktsegment AS value, count(*) AS n FROM customer GROUP BY 1 UNION ALL SELECT 'NONE', 0")
def role_histogram(spark, d):
    known = [r[0] for r in read(spark, d, "customer").select("c_mktsegment").distinct().limit(100).collect()]
    return metrics.histogram(read(spark, d, "customer"), "c_mktsegment", [*known, "NONE"])


@query("SELECT source, count(DISTINCT lang) AS langs FROM documents GROUP BY 1 HAVING count(DISTINCT lang) > 1")
def count_disagreement(spark, d):
    x = text_checks.cross_section(read(spark, d, "documents"), "source", "lang", "lang")
    return x.select("source", F.size("values").cast("long").alias("langs"))
