"""Queries of the platform around documents: tenants, pages, metrics, memory, retrieval, stores, runs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from tabloom.operators import conditions, expressions, lifecycle, listings, metrics, resolution, retrieval, usage
from tabloom.operators.joins import shared_path
from tabloom.operators.vector_store import PivotIndex, VectorStore
from tabloom.plans.catalogue import day, events, query, read
from tabloom.plans.texts import STOP_SQL, say

# Tenants, windows, pages


@query("SELECT count(*) AS n, CAST(min(ts) AS VARCHAR) >= '2024-01-03' AS whole FROM events WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-09 12:00:00'")
def named_window(spark, d):
    since, until, _ = usage.window(" 7D ", datetime(2024, 1, 9, 12))
    e = usage.in_window(events(spark, d), since, until)
    return e.agg(F.count("*").alias("n"), (F.min("ts").cast("string") >= "2024-01-03").alias("whole"))


@query("SELECT event_type, count(*) AS n FROM events WHERE user_id % 10 = 3 AND user_id % 4 <> 0 GROUP BY 1")
def tenant_policy(spark, d):
    """Rows of one tenant through the policy, without deleted ones."""
    e = events(spark, d).withColumn("deleted_at", F.when(F.col("user_id") % 4 == 0, F.col("ts")))
    policy = usage.RowPolicy({"events": e, "other": e}, "3", "org")
    return usage.alive(policy.read("events")).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7)), 8) AS score FROM embeddings WHERE vec_id % 4 = 1 AND label = 3 ORDER BY list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7)) DESC, vec_id LIMIT 10")
def filtered_search(spark, d):
    """Tenant and type come before the scoring; all vectors are of the query's provider."""
    e = read(spark, d, "embeddings")
    asked = e.where("vec_id = 7").select("embedding").first()[0]
    mine = usage.tenant_scope(e.withColumn("org", (F.col("vec_id") % 4).cast("string")), "1", "org").where("label = 3").withColumn("provider", F.lit("p1"))
    return retrieval.cosine_top_k(retrieval.same_provider(mine, "p1"), list(asked), 10, "vec_id", "embedding").select("id", F.round("score", 8).alias("score"))


@query("SELECT event_id, event_type FROM events WHERE user_id % 10 = 3 AND event_type = 'error' ORDER BY ts DESC, event_id LIMIT 50")
def audit_page(spark, d):
    e = usage.tenant_scope(events(spark, d), "3", "org").where("event_type = 'error'")
    return usage.offset_page(e, [F.desc("ts"), "event_id"], 50, 0).select("event_id", "event_type")


@query("SELECT c_custkey, c_name FROM customer WHERE c_name ILIKE '%00%' OR c_mktsegment ILIKE '%00%' ORDER BY c_custkey LIMIT 40 OFFSET 20")
def records_page(spark, d):
    return usage.offset_page(usage.search(read(spark, d, "customer"), "00", ["c_name", "c_mktsegment"]), ["c_custkey"], 40, 20).select("c_custkey", "c_name")


@query("SELECT doc_id FROM documents WHERE lang = 'de' ORDER BY source, doc_id LIMIT 25 OFFSET 5")
def chunk_page(spark, d):
    return usage.offset_page(read(spark, d, "documents").where("lang = 'de'"), ["source", "doc_id"], 25, 5).select("doc_id")


@query("SELECT s_suppkey AS result_id, CASE WHEN s_acctbal <= 5000 THEN 'PASS' ELSE 'FAIL' END AS outcome FROM supplier ORDER BY s_nationkey, s_suppkey LIMIT 100")
def data_grid(spark, d):
    """A page of results, each with its verdict."""
    from tabloom.operators import lab

    s = read(spark, d, "supplier").select("s_suppkey", "s_nationkey", say(F.col("s_acctbal").cast("decimal(18,2)"), " mg").alias("value_text"), F.lit("NMT 5,000 mg").alias("criterion"))
    page = usage.offset_page(s, ["s_nationkey", "s_suppkey"], 100, 0)
    return lab.conformance(page).select(F.col("s_suppkey").alias("result_id"), "outcome")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag ILIKE '%r%' AND l_linestatus = 'F' ORDER BY l_orderkey DESC, l_linenumber, l_partkey, l_suppkey LIMIT 30")
def event_grid(spark, d):
    li = usage.search(read(spark, d, "lineitem"), "r", ["l_returnflag"]).where("l_linestatus = 'F'")
    return usage.offset_page(li, [F.desc("l_orderkey"), "l_linenumber", "l_partkey", "l_suppkey"], 30, 0).select("l_orderkey", "l_linenumber")


@query("SELECT c_custkey AS project_id, c_custkey IN (SELECT o_custkey FROM orders) AS has_orders, c_custkey IN (SELECT s_suppkey FROM supplier) AS has_sites FROM customer ORDER BY c_custkey LIMIT 100")
def project_page(spark, d):
    p = usage.offset_page(read(spark, d, "customer").select(F.col("c_custkey").alias("project_id")), ["project_id"], 100, 0)
    return metrics.project_flags(p, {"orders": read(spark, d, "orders").select(F.col("o_custkey").alias("project_id")), "sites": read(spark, d, "supplier").select(F.col("s_suppkey").alias("project_id"))})


@query("SELECT p_brand AS pattern, count(DISTINCT p_size % 7) AS tenants, sum(p_size)::BIGINT AS weight FROM part WHERE p_size % 7 <> 2 AND p_size % 7 IN (0, 1, 3, 5) AND p_size % 3 <> 0 GROUP BY 1 HAVING count(DISTINCT p_size % 7) >= 3")
def shared_patterns(spark, d):
    """Patterns of other tenants that opted in, net approvals above zero, shared by three at least."""
    k = F.col("p_size")
    p = read(spark, d, "part").select(F.col("p_brand").alias("pattern"), (k % 7).alias("org"), k.alias("weight"), F.when(k % 3 == 0, -1).otherwise(1).alias("net"))
    opted = spark.createDataFrame([(0,), (1,), (2,), (3,), (5,)], "o int")
    return metrics.k_anonymous(usage.where_exists(p.where("org <> 2 and net > 0"), "org", opted, "o"), ["pattern"], "org", "weight")


# Metrics


@query("SELECT 'escaped_error_rate' AS key, e * 10000.0 / f AS value, CAST(NULL AS VARCHAR) AS unavailable_reason, f AS sample FROM (SELECT 2 * count(*) AS f FROM orders), (SELECT count(*) FILTER (l_returnflag = 'R') AS e FROM lineitem)")
def escaped_errors(spark, d):
    g = read(spark, d, "orders").select(F.array(F.lit("a"), F.lit("b")).alias("fields"))
    s = read(spark, d, "lineitem").select(F.when(F.col("l_returnflag") != "N", F.col("l_returnflag") == "R").alias("found_after_approval"))
    return metrics.escaped_error_rate(g, s, read(spark, d, "orders").where("o_orderstatus = 'F'"))


@query("SELECT 'family_reuse_rate' AS key, count(*) FILTER (p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 48)) / count(*) AS value, CAST(NULL AS VARCHAR) AS unavailable_reason, count(*) AS sample FROM part")
def family_reuse(spark, d):
    m = read(spark, d, "lineitem").select(F.col("l_partkey").alias("template_id"), (F.col("l_quantity") >= 48).alias("approved"))
    return metrics.family_reuse_rate(read(spark, d, "part").select(F.col("p_partkey").alias("template_id")), m)


@query("SELECT event_id, round(value / user_id * 1000, 6) AS per_thousand FROM events WHERE user_id > 0")
def batch_projection(spark, d):
    return metrics.batch_projection(read(spark, d, "events"), "value", "user_id").select("event_id", F.round("per_thousand", 6).alias("per_thousand"))


@query("WITH b AS (SELECT CASE WHEN l_discount < 0.03 THEN 'BLOCK' WHEN l_discount < 0.07 THEN 'REVIEW' ELSE 'CONFIRM' END AS value FROM lineitem) SELECT value, count(*) AS n FROM b GROUP BY 1 UNION ALL SELECT 'AUTO_ACCEPT', 0")
def band_counts(spark, d):
    x = F.col("l_discount")
    b = read(spark, d, "lineitem").select(F.when(x < 0.03, "BLOCK").when(x < 0.07, "REVIEW").otherwise("CONFIRM").alias("band"))
    return metrics.histogram(b, "band", ["BLOCK", "REVIEW", "CONFIRM", "AUTO_ACCEPT"])


@query("SELECT 0 AS rank, 'deterministic' AS key, count(*) FILTER (event_type <> 'view') / count(*) AS value, CAST(NULL AS VARCHAR) AS unavailable_reason, count(*) AS sample FROM events UNION ALL SELECT 1, 'none', NULL, 'nothing ran', 0")
def metrics_in_order(spark, d):
    e = read(spark, d, "events")
    n, every = F.count_if(F.col("event_type") != "view"), F.count("*")
    return metrics.all_metrics(metrics.guarded_rate(e, "deterministic", n, every, "nothing ran"), metrics.guarded_rate(e.where("event_id < 0"), "none", n, every, "nothing ran"))


@query("SELECT 'c_acctbal' AS \"column\", count(*) AS non_empty, 'number' AS observed_type FROM customer UNION ALL SELECT 'flag', count(*) FILTER (c_custkey % 3 = 0), 'boolean' FROM customer UNION ALL SELECT 'made', count(*), 'date' FROM customer UNION ALL SELECT 'mixed', count(*), 'text' FROM customer UNION ALL SELECT 'void', 0, NULL")
def column_sentences(spark, d):
    k = F.col("c_custkey")
    c = read(spark, d, "customer").select("c_acctbal", F.when(k % 3 == 0, "yes").otherwise("").alias("flag"), F.lit("2024-05-06").alias("made"), F.when(k % 2 == 0, "12").otherwise("n/a").alias("mixed"), F.lit(None).cast("string").alias("void"))
    return metrics.column_types(c, ["c_acctbal", "flag", "made", "mixed", "void"])


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS r, count(*) OVER () AS n FROM orders WHERE o_orderstatus = 'P') WHERE r IN (0, least(n - 1, n // 3), least(n - 1, 2 * n // 3))")
def canary_rows(spark, d):
    """The evenly spaced rows that a batch runs first."""
    o = read(spark, d, "orders").where("o_orderstatus = 'P'").select("o_orderkey")
    out = usage.canary_run(o, "o_orderkey", lambda x: x.withColumn("ok", F.lit(True)), F.col("ok") == F.lit(False))
    return out.where("canary").select("o_orderkey")


@query("SELECT canary, ok, count(*) AS n FROM (SELECT r IN (0, least(n - 1, n // 3), least(n - 1, 2 * n // 3)) AS canary, CASE WHEN r IN (0, least(n - 1, n // 3), least(n - 1, 2 * n // 3)) THEN false END AS ok FROM (SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS r, count(*) OVER () AS n FROM nation)) GROUP BY 1, 2")
def canary_gate(spark, d):
    """A first row fails, so the others are not worked on."""
    n = read(spark, d, "nation").select("n_nationkey")
    out = usage.canary_run(n, "n_nationkey", lambda x: x.withColumn("ok", F.lit(False)), ~F.col("ok"))
    return out.groupBy("canary", "ok").agg(F.count("*").alias("n"))


@query("SELECT 'orders' AS \"table\", count(*) AS deleted FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 'lines', count(*) FROM lineitem WHERE l_linestatus = 'P'")
def offboarded(spark, d):
    o, li = read(spark, d, "orders").withColumnRenamed("o_orderstatus", "org_id"), read(spark, d, "lineitem").withColumnRenamed("l_linestatus", "org_id")
    kept, counts, digest = lifecycle.offboard({"orders": o, "lines": li}, "P")
    if len(digest) != 64 or kept["orders"].where("org_id = 'P'").limit(1).count():
        raise ValueError("rows of the tenant stayed")
    return spark.createDataFrame(sorted(counts.items()), "table string, deleted long")


@query("""
WITH c AS (SELECT c_custkey FROM customer WHERE c_acctbal < 0), o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c) OR o_orderstatus = 'P'),
l AS (SELECT l_orderkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o))
SELECT 1 AS step, 'lines' AS "table", count(*) AS gone, (SELECT count(*) FROM lineitem) - count(*) AS kept FROM l UNION ALL SELECT 2, 'orders', count(*), (SELECT count(*) FROM orders) - count(*) FROM o
UNION ALL SELECT 3, 'customers', count(*), (SELECT count(*) FROM customer) - count(*) FROM c
""")
def retired_graph(spark, d):
    """Customers in debt and pending orders go, with all that hangs on them, lines first."""
    li = read(spark, d, "lineitem").withColumn("id", F.concat_ws("/", "l_orderkey", "l_linenumber", F.xxhash64("*").cast("string")))
    li = li.withColumn("id", F.concat_ws("#", "id", F.row_number().over(Window.partitionBy("id").orderBy("id"))))
    tables = {"customers": (read(spark, d, "customer"), "c_custkey"), "orders": (read(spark, d, "orders"), "o_orderkey"), "lines": (li, "id")}
    out = lifecycle.retire(tables, [("lines", "l_orderkey", "orders"), ("orders", "o_custkey", "customers")], {"customers": F.col("c_acctbal") < 0, "orders": F.col("o_orderstatus") == "P"})
    kept = None
    for name, df in out.kept.items():
        one = df.agg(F.count("*").alias("kept")).withColumn("table", F.lit(name))
        kept = one if kept is None else kept.unionByName(one)
    return out.manifest.groupBy("step", "table").agg(F.count("*").alias("gone")).join(kept, "table").select("step", "table", "gone", "kept")


@query("SELECT event_type, count(*) AS removed, CAST(max(CAST(ts AS DATE)) AS VARCHAR) AS newest FROM events WHERE ts < TIMESTAMP '2024-01-30' - INTERVAL 20 DAY GROUP BY 1")
def retention_cutoff(spark, d):
    e = read(spark, d, "events").where(F.col("ts") < lifecycle.cutoff(20, datetime(2024, 1, 30)))
    return e.groupBy("event_type").agg(F.count("*").alias("removed"), day(F.max("ts")).alias("newest"))


@query("SELECT p_partkey, sha256('d:{s:1:a=i:' || p_size || ',s:1:b=l:[i:1,b:1],s:1:n=s:' || length(p_name) || ':' || p_name || '}') AS hash, true AS same, true AS apart FROM part")
def canonical_hashes(spark, d):
    """Two spellings of one value have one hash, and a number as a text has another."""
    p = read(spark, d, "part")
    one, two = say('{"a": ', "$p_size", '.0, "b": [1, true], "n": "', "$p_name", '"}'), say('{"n": "', "$p_name", '", "b": [1,true], "a": ', "$p_size", "}")
    other = say('{"n": "', "$p_name", '", "b": [1,true], "a": "', "$p_size", '"}')
    h = expressions.canonical_hash_of
    return p.select("p_partkey", h(one).alias("hash"), h(two).alias("two"), h(other).alias("other")).select("p_partkey", "hash", (F.col("hash") == F.col("two")).alias("same"), (F.col("hash") != F.col("other")).alias("apart"))


# Joins with a library operator behind them


@query("SELECT c_mktsegment AS function, count(*) AS documents FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def docs_by_function(spark, d):
    return usage.counts_by_dimension(read(spark, d, "orders"), "o_custkey", read(spark, d, "customer"), "c_custkey", "c_mktsegment", "documents").withColumnRenamed("label", "function")


@query("SELECT p_brand AS template, count(*) AS versions, count(DISTINCT l_orderkey) AS uses FROM part JOIN lineitem ON p_partkey = l_partkey JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P' GROUP BY 1 ORDER BY uses DESC, template LIMIT 5")
def top_templates(spark, d):
    o = read(spark, d, "orders").where("o_orderstatus <> 'P'")
    li = usage.where_exists(read(spark, d, "lineitem").select("l_orderkey", "l_partkey"), "l_orderkey", o, "o_orderkey")
    p = read(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return usage.top_used(li.join(p, "l_partkey"), "p_brand", "l_orderkey", 5).withColumnRenamed("key", "template")


@query("SELECT count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def semi_count(spark, d):
    p = read(spark, d, "orders").where("o_orderstatus = 'P'")
    return usage.where_exists(read(spark, d, "lineitem").select("l_orderkey"), "l_orderkey", p, "o_orderkey").agg(F.count("*").alias("n"))


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)")
def anti_unused(spark, d):
    return usage.where_missing(read(spark, d, "part").select("p_partkey"), "p_partkey", read(spark, d, "lineitem").where("l_quantity >= 49"), "l_partkey")


# Records


@query("SELECT c_custkey, 'info.name' AS path, c_name AS before, upper(c_name) AS after FROM customer WHERE c_custkey % 2 = 0 AND c_name <> upper(c_name) UNION ALL SELECT c_custkey, 'info.place.segment', c_mktsegment, NULL FROM customer WHERE c_custkey % 3 = 0")
def field_changes(spark, d):
    c = read(spark, d, "customer")
    pack = lambda name, seg: c.select("c_custkey", F.struct(name.alias("name"), F.struct(seg.alias("segment"), F.lit(1).alias("k")).alias("place")).alias("info"))
    a = pack(F.col("c_name"), F.col("c_mktsegment"))
    b = pack(F.when(F.col("c_custkey") % 2 == 0, F.upper("c_name")).otherwise(F.col("c_name")), F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")))
    return usage.field_diff(a, b, "c_custkey")


@query("SELECT o_orderkey, CASE WHEN l IS NULL THEN 'removed' WHEN o_orderstatus = 'P' THEN 'changed' ELSE 'same' END AS status FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey AS l FROM lineitem) ON l = o_orderkey UNION ALL SELECT DISTINCT l_orderkey, 'added' FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)")
def row_diff(spark, d):
    """All orders against those that have lines, pending ones with another status."""
    o = read(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    k = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    b = k.join(o, "o_orderkey", "left").withColumn("o_orderstatus", F.when(F.col("o_orderstatus") == "P", "X").otherwise(F.col("o_orderstatus")))
    return usage.row_diff(o, b, "o_orderkey", ["o_orderstatus"])


@query("SELECT p_partkey, i::INTEGER AS position, CASE i WHEN 0 THEN p_brand ELSE p_type END AS item FROM part, range(2) r(i) WHERE p_size % 4 <> 0")
def expanded(spark, d):
    p = read(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 4 != 0, F.array("p_brand", "p_type")).otherwise(F.array().cast("array<string>")).alias("items"))
    return usage.expand(p, "items", "item").drop("items")


@query("SELECT l_orderkey AS k, max(l_linenumber) AS version FROM lineitem GROUP BY 1")
def stored_upserts(spark, d):
    """Rows written in two turns to a store, the newest of each key read back."""
    from tabloom.sources import records

    path = shared_path(spark, "upserts")
    li = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("version"))
    records.write_records(li.where("version <= 3"), path)
    records.write_records(li.where("version > 3"), path)
    return usage.latest_wins(spark.read.schema(li.schema).parquet(path), ["k"], [F.desc("version")])


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'new' ELSE s_name END AS name FROM supplier")
def upserted_rows(spark, d):
    from tabloom.sources import records

    old = read(spark, d, "supplier").select("s_suppkey", F.col("s_name").alias("name"))
    return records.upsert(old, old.where("s_suppkey % 3 = 0").withColumn("name", F.lit("new")), ["s_suppkey"])


@query("SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 9)), 8) AS score FROM embeddings ORDER BY list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 9)) DESC, vec_id LIMIT 5")
def vector_store(spark, d):
    """Vectors put into a store as JSON text and back, and the nearest of one."""
    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    size = e.select(F.size("embedding")).first()[0]
    coded = e.select("id", retrieval.read_vector(retrieval.write_vector(F.col("embedding")), size).alias("embedding"), F.lit("p1").alias("provider"), F.lit("o").alias("org"))
    store = VectorStore(spark, shared_path(spark, "vectors"), 8)
    store.put(coded)
    asked = e.where("id = 9").select("embedding").first()[0]
    return store.nearest("o", list(asked), "p1", 5).select("id", F.round("score", 8).alias("score"))


TENANTS_SQL = " UNION ALL ".join(
    f"SELECT '{org}' AS org, id, round(score, 8) AS score FROM (SELECT vec_id AS id, list_cosine_similarity({e}, (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 9)) AS score FROM embeddings {gone} ORDER BY score DESC, vec_id LIMIT 8)"
    for org, e, gone in (("a", "CASE WHEN vec_id % 3 = 0 THEN list_reverse(embedding::DOUBLE[]) ELSE embedding::DOUBLE[] END", ""), ("b", "list_transform(embedding::DOUBLE[], lambda x: -x)", "WHERE vec_id % 5 <> 1"))
)


@query(TENANTS_SQL)
def tenant_vectors(spark, d):
    """Two tenants with the same ids; one corrects a third of its vectors in a second put, the other takes a fifth of its out."""
    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"), F.lit("p1").alias("provider"))
    asked = list(e.where("id = 9").select("embedding").first()[0])
    of = lambda org, rows: rows.withColumn("org", F.lit(org))
    store = VectorStore(spark, shared_path(spark, "vectors"), 8)
    store.put(of("a", e).unionByName(of("b", e.withColumn("embedding", F.transform("embedding", lambda x: -x)))))
    store.put(of("a", e.where("id % 3 = 0").withColumn("embedding", F.reverse("embedding"))))
    store.remove(of("b", e.where("id % 5 = 1")))
    near = lambda org: of(org, store.nearest(org, asked, "p1", 8).select("id", F.round("score", 8).alias("score")))
    return near("a").unionByName(near("b"))


@query("SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 11)), 8) AS score FROM embeddings ORDER BY list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 11)) DESC, vec_id LIMIT 20")
def pivot_search(spark, d):
    e = read(spark, d, "embeddings")
    index = PivotIndex(spark, shared_path(spark, "pivots")).build(e, "vec_id", "embedding", 32)
    asked = e.where("vec_id = 11").select("embedding").first()[0]
    return index.search([float(x) for x in asked], 20).select("id", F.round("score", 8).alias("score"))


# Conditions


RULE = "(amount > 100000 and status == 'F') or priority in ['1-URGENT', '2-HIGH']"


@query("SELECT o_orderkey FROM orders WHERE (o_totalprice > 100000 AND o_orderstatus = 'F') OR o_orderpriority IN ('1-URGENT', '2-HIGH')")
def legacy_rule(spark, d):
    o = read(spark, d, "orders")
    fields = {"amount": F.col("o_totalprice"), "status": F.col("o_orderstatus"), "priority": F.col("o_orderpriority")}
    return o.where(conditions.legacy(RULE, fields) & ~conditions.legacy("not a ( rule", fields)).select("o_orderkey")


@query("SELECT passed, count(*) AS n FROM (SELECT (CASE WHEN o_totalprice > 100000 THEN 'KEEP' ELSE 'REMOVE' END) = CASE WHEN o_orderkey % 9 = 0 THEN 'KEEP' WHEN o_totalprice > 100000 THEN 'KEEP' ELSE 'REMOVE' END AS passed FROM orders) GROUP BY 1")
def rule_test_cases(spark, d):
    expected = F.when(F.col("o_orderkey") % 9 == 0, "KEEP").when(F.col("o_totalprice") > 100000, "KEEP").otherwise("REMOVE")
    o = read(spark, d, "orders").select(F.col("o_totalprice").alias("amount"), expected.alias("expected"))
    return conditions.run_test_cases(o, "amount > 100000", ["amount"]).groupBy("passed").agg(F.count("*").alias("n"))


@query(
    "SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 THEN 'amount' END AS inputs, CASE WHEN p_partkey % 5 <> 0 THEN 'amount is more than ' || p_size END AS english, "
    "CASE WHEN p_partkey % 5 <> 0 THEN 'If amount is more than ' || p_size || ', keep it; otherwise remove it. If amount is missing, a person decides.' END AS sentence, CASE WHEN p_partkey % 5 = 0 THEN 'outside the language' END AS fault FROM part"
)
def rule_readings(spark, d):
    """What the language says about a rule of each part; every fifth is no rule."""
    rule = F.when(F.col("p_partkey") % 5 == 0, F.lit("__import__('os')")).otherwise(say("amount > ", "$p_size"))
    return read(spark, d, "part").select("p_partkey", expressions.rule_reading(rule).alias("r")).select("p_partkey", "r.inputs", "r.english", "r.sentence", "r.fault")


@query("SELECT s_nationkey AS manifest, (row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1)::INTEGER AS place, 'u' || s_suppkey AS unit FROM supplier")
def dependency_order(spark, d):
    """A manifest for each nation, whose units need the one before them."""
    w = Window.partitionBy("s_nationkey").orderBy("s_suppkey")
    s = read(spark, d, "supplier").withColumn("before", F.lag("s_suppkey").over(w))
    units = s.select(F.col("s_nationkey").alias("manifest"), say("u", "$s_suppkey").alias("unit"), F.when(F.col("before").isNull(), "source").otherwise("computed").alias("kind"), F.when(F.col("before").isNull(), F.lit("x")).otherwise(say("u", "$before", " + 1")).alias("expression"))
    return expressions.dependency_places(units)


# Matching


#: Five layouts of six headers, and the field that each has to get.
LAYOUTS = (
    (("Case ID", "worldwide_case_id", 1.0), ("Local case ID", "local_case_id", 1.0), ("Dosage", None, 0.0), ("Patient age (years)", "patient_age", 0.7), ("Sex", "patient_sex", 1.0), ("Gender", None, 0.0)),
    (("Local case no.", "local_case_id", 0.7), ("Seriousness criteria", "seriousness_criteria", 1.0), ("Serious?", "is_serious", 1.0), ("Description", None, 0.0), ("Adverse event as reported", "verbatim_term", 0.7), ("", None, 0.0)),
    (("Suspect product name", "drug_name", 0.7), ("Role", "drug_role", 1.0), ("INDICATION", "drug_indication", 1.0), ("MedDRA version", "version", 1.0), ("PT", None, 0.0), ("Preferred term", "pt", 1.0)),
    (("Date received", "initial_receipt_date", 1.0), ("Follow-up receipt", "latest_receipt_date", 1.0), ("Case version", "case_version", 1.0), ("Country", None, 0.0), ("Country of occurrence", "country", 1.0), ("Reporter", "qualification", 1.0)),
    (("Outcome of event", "event_outcome", 1.0), ("Patient outcome", "case_outcome", 1.0), ("Onset date", "onset_date", 1.0), ("Average", None, 0.0), ("Protocol number", "study_id", 1.0), ("Narrative text", "narrative", 0.7)),
)
LAYOUT_SQL = ", ".join(f"({i}, {k}, '{h}', {repr(f) if f else 'NULL'}, {c}::DOUBLE)" for i, rows in enumerate(LAYOUTS) for k, (h, f, c) in enumerate(rows))


@query(f"SELECT p_partkey // 6 AS source, p_partkey % 6 AS place, v.header, v.field, v.confidence FROM part JOIN (VALUES {LAYOUT_SQL}) v(layout, place, header, field, confidence) ON v.layout = p_partkey // 6 % 5 AND v.place = p_partkey % 6")
def header_suggestions(spark, d):
    """A source for every six parts, in one of five layouts."""
    k = F.col("p_partkey")
    names = F.array(*[F.array(*[F.lit(h) for h, _, _ in rows]) for rows in LAYOUTS])
    source, place = F.floor(k / 6), k % 6
    rows = read(spark, d, "part").select(source.alias("source"), place.alias("place"), F.get(F.get(names, (source % 5).cast("int")), place.cast("int")).alias("header"))
    return listings.suggest_fields(rows)


@query(
    "WITH m AS (SELECT p_brand AS source, CASE p_size % 4 WHEN 0 THEN 'worldwide_case_id' WHEN 1 THEN 'country' WHEN 2 THEN 'shoe_size' END AS field FROM part WHERE p_size % 4 <> 0 OR p_brand <> 'Brand#13') "
    "SELECT source, 'missing' AS fault, 'worldwide_case_id' AS field FROM m GROUP BY source HAVING count(*) FILTER (field = 'worldwide_case_id') = 0 UNION ALL SELECT DISTINCT source, 'unknown', field FROM m WHERE field = 'shoe_size' UNION ALL SELECT source, 'duplicate', field FROM m WHERE field IS NOT NULL GROUP BY source, field HAVING count(*) > 1"
)
def mapping_faults(spark, d):
    k = F.col("p_size") % 4
    m = read(spark, d, "part").where((k != 0) | (F.col("p_brand") != "Brand#13"))
    return listings.mapping_faults(m.select(F.col("p_brand").alias("source"), F.col("p_partkey").alias("column"), F.when(k == 0, "worldwide_case_id").when(k == 1, "country").when(k == 2, "shoe_size").alias("field")))


MEMORY_SQL = "(SELECT p_brand AS target, p_partkey AS \"column\", (p_size % 10) / 10.0::DOUBLE AS similarity, p_size % 6 AS approvals, p_size % 4 AS rejections FROM part WHERE p_partkey % 3 = 1) m"


@query(f"SELECT target, \"column\", round(score, 4) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY score DESC, net DESC, \"column\") AS rank FROM (SELECT *, approvals - rejections AS net, 0.6 * similarity + 0.4 * (1 - exp(-(approvals - rejections) / 8.0)) - 0.25 * rejections AS score FROM {MEMORY_SQL}) WHERE net > 0 AND similarity >= 0.25) WHERE rank <= 3")
def memory_lookup(spark, d):
    k = F.col("p_size")
    p = read(spark, d, "part").select(F.col("p_brand").alias("target"), F.col("p_partkey").alias("column"), ((k % 10) / 10).alias("similarity"), (k % 6).alias("approvals"), (k % 4).alias("rejections"), (F.col("p_partkey") % 3).cast("string").alias("org_id"))
    return resolution.memory_lookup(p, "1", 3).select("target", "column", "score", F.col("rank").cast("long").alias("rank"))


TIER_SQL = "SELECT DISTINCT p_brand AS target, 'Col ' || p_brand AS \"column\", {} AS tier, {}::DOUBLE AS confidence FROM part WHERE {}"
DIGIT = "right(p_brand, 1)::INTEGER"


def tier_tables(spark, d):
    """Brands as targets: by their last digit one is known by its merge field, one by the dictionary, one by its name, and others not at all."""
    b = read(spark, d, "part").select("p_brand").distinct()
    digit = F.substring("p_brand", -1, 1).cast("int")
    targets = b.select(F.when(digit == 3, say("col_", F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))))).otherwise(F.col("p_brand")).alias("target"), F.when(digit == 1, say("col_", F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))))).alias("mergefield"), "p_brand")
    columns = b.select(say("Col ", "$p_brand").alias("column"))
    known = b.where(digit == 2).select(F.col("p_brand").alias("target"), F.upper(say("Col ", "$p_brand")).alias("column"))
    return targets, columns, known


@query(TIER_SQL.format("CASE " + DIGIT + " WHEN 1 THEN 'mergefield' WHEN 2 THEN 'dictionary' ELSE 'name' END", "CASE " + DIGIT + " WHEN 1 THEN 1.0 WHEN 2 THEN 0.95 ELSE 0.9 END", DIGIT + " IN (1, 2, 3)").replace("p_brand AS target", "CASE WHEN " + DIGIT + " = 3 THEN 'col_' || lower(replace(p_brand, '#', '_')) ELSE p_brand END AS target"))
def suggestion_tiers(spark, d):
    targets, columns, known = tier_tables(spark, d)
    return resolution.tiered(targets.select("target", "mergefield"), columns, known)


@query("SELECT p_size % 4 AS kind, p_brand = 'Brand#13' AS material, concat_ws(',', CASE WHEN p_size % 4 = 0 THEN 'type_mismatch' END, CASE WHEN p_brand = 'Brand#13' AND p_size % 4 <> 3 THEN 'thin_evidence' END, CASE WHEN p_size % 4 NOT IN (2, 3) THEN 'no_precedent' END) AS vetoes, count(*) AS n FROM part GROUP BY 1, 2, 3")
def candidate_vetoes(spark, d):
    k = F.col("p_size") % 4
    sig = lambda name, s: F.struct(F.lit(name).alias("name"), s.cast("double").alias("s"))
    signals = F.array(sig("name", F.when(k.isin(1, 3), 0.5).otherwise(0.0)), sig("historical_approvals", F.when(k.isin(2, 3), 0.5).otherwise(0.0)))
    v = resolution.material_vetoes(signals, F.col("p_brand") == "Brand#13", F.when(k == 0, "MISMATCH").otherwise("COMPATIBLE"))
    return read(spark, d, "part").groupBy(k.alias("kind"), (F.col("p_brand") == "Brand#13").alias("material"), F.array_join(v, ",").alias("vetoes")).agg(F.count("*").alias("n"))


@query("""
WITH RECURSIVE p AS (SELECT p_brand AS g, p_partkey AS t, (p_partkey * 7 + j * j * 3) % 20 AS c, (p_partkey * 31 + j * 17) % 97 AS s FROM part, range(4) r(j)),
o AS (SELECT g, t, row_number() OVER (PARTITION BY g ORDER BY max(s) DESC, 'T' || t) AS i FROM p GROUP BY g, t),
w AS (SELECT g, i, any_value(t) AS t, list(c ORDER BY s DESC, 'c' || c) AS wants FROM p JOIN o USING (g, t) GROUP BY g, i),
r AS (
  SELECT DISTINCT g, 0::BIGINT AS i, []::BIGINT[] AS taken, NULL::BIGINT AS t, NULL::BIGINT AS c FROM p
  UNION ALL
  SELECT g, i, list_append(taken, pick), t, pick FROM (
    SELECT w.g, w.i, r.taken, w.t, list_filter(w.wants, lambda x: NOT list_contains(r.taken, x))[1] AS pick FROM r JOIN w ON w.g = r.g AND w.i = r.i + 1))
SELECT g AS brand, 'T' || t AS target, 'c' || c AS "column" FROM r WHERE c IS NOT NULL
""")
def assigned_bindings(spark, d):
    """Every part asks for four of twenty columns of its brand."""
    p, k = read(spark, d, "part"), F.col("p_partkey")
    j = F.explode(F.array(*[F.struct(F.lit(x * x * 3).alias("at"), F.lit(x * 17).alias("more")) for x in range(4)])).alias("j")
    p = p.select(F.col("p_brand").alias("brand"), k, j).select("brand", say("T", k).alias("target"), say("c", (k * 7 + F.col("j.at")) % 20).alias("column"), (((k * 31 + F.col("j.more")) % 97) / 100).alias("score"), F.lit("HIGH").alias("band"))
    return resolution.assign(p, "brand").select("brand", "target", "column")


@query("SELECT o_orderkey, 'told: note' AS note, 'F' AS status FROM orders WHERE o_orderstatus = 'F'")
def narrative_hook(spark, d):
    U = resolution.Unit
    units = [U("note", "human", ""), U("status", "source", "o_orderstatus")]
    o = read(spark, d, "orders").where("o_orderstatus = 'F'")
    return resolution.resolve_hooked(o, units, lambda unit: F.lit(f"told: {unit}")).select("o_orderkey", "note", "status")


# Retrieval


@query("SELECT p_partkey, concat_ws(' ', '14.' || p_size, p_name, CASE WHEN p_size % 2 = 0 THEN 'say it' END, p_brand, CAST(p_size AS VARCHAR)) AS q FROM part")
def section_queries(spark, d):
    q = retrieval.section_query(say("14.", "$p_size"), F.col("p_name"), F.when(F.col("p_size") % 2 == 0, "say it").otherwise(""), [F.col("p_brand"), F.col("p_size")])
    return read(spark, d, "part").select("p_partkey", q.alias("q"))


RANK_TOKENS = f"list_filter(regexp_extract_all(lower(text), '[a-z0-9]+(?:[./\\-][a-z0-9]+)*'), lambda w: NOT list_contains({STOP_SQL}, w))"


@query(
    f"WITH c AS (SELECT p_partkey AS id, p_name || ' ' || p_type AS text, CASE WHEN p_size % 3 = 0 THEN '14.1.' || p_size END AS table_id FROM part WHERE p_partkey % 2 = 0 AND p_size % 5 <> 0), d AS (SELECT id, unnest({RANK_TOKENS}) AS term FROM c), t AS (SELECT id, term, count(*) AS tf FROM d GROUP BY 1, 2), n AS (SELECT count(*) AS n FROM c), "
    "i AS (SELECT term, ln((1.0 + n) / (1.0 + count(*))) + 1 AS idf FROM t, n GROUP BY term, n), w AS (SELECT id, term, tf * idf AS w FROM t JOIN i USING (term)), q AS (SELECT term, idf AS qw FROM (VALUES ('cold'), ('widget')) v(term) JOIN i USING (term)), qn AS (SELECT sqrt(sum(qw * qw)) AS qn FROM q), nn AS (SELECT id, sqrt(sum(w * w)) AS norm FROM w GROUP BY 1), "
    "s AS (SELECT w.id, sum(w * qw) / (norm * qn) AS score FROM w JOIN q USING (term) JOIN nn USING (id), qn GROUP BY w.id, norm, qn), r AS (SELECT c.id, coalesce(score, 0) + CASE WHEN table_id IS NOT NULL THEN 0.15 ELSE 0 END AS score, table_id IS NOT NULL AS t FROM c LEFT JOIN s USING (id)) SELECT id, round(score, 6) AS score FROM r WHERE score > 0 ORDER BY round(r.score, 9) DESC, NOT t, id LIMIT 12"
)
def section_chunks(spark, d):
    k = F.col("p_size")
    c = read(spark, d, "part").select(F.col("p_partkey").alias("id"), say("$p_name", " ", "$p_type").alias("text"), F.when(k % 3 == 0, say("14.1.", k)).alias("table_id"), F.when(k % 5 == 0, "other").otherwise("tlf").alias("doc_type"), (F.col("p_partkey") % 2).cast("string").alias("org_id"))
    return retrieval.retrieve_section(c, "cold widget", "0", ["tlf"], "14.1", 12).select("id", F.round("score", 6).alias("score"))


@query(f"SELECT m.target, m.prior, e.evidence FROM (SELECT p_brand AS target, count(*) AS prior FROM part WHERE p_size <= 10 GROUP BY 1) m FULL JOIN (SELECT p_brand AS target, min(p_partkey) AS evidence FROM part WHERE p_size > 20 GROUP BY 1) e ON e.target = m.target WHERE m.target IS NOT NULL")
def field_evidence(spark, d):
    p = read(spark, d, "part").select(F.col("p_brand").alias("target"), F.col("p_partkey").alias("id"), F.col("p_name").alias("column"), F.lit(0.5).alias("score"), F.col("p_partkey").alias("rank"), "p_size")
    out = retrieval.field_evidence(p.where("p_size <= 10"), p.where("p_size > 20"))
    return out.select("target", F.size("prior").cast("long").alias("prior"), F.get("evidence", F.lit(0))["id"].alias("evidence")).where("prior is not null and prior > 0")


FUSED = (
    "WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 7), v AS (SELECT vec_id AS id, list_cosine_similarity(embedding::DOUBLE[], q) AS vec FROM embeddings, q), l AS (SELECT p_partkey AS id, p_size / 10.0::DOUBLE AS lex FROM part), t AS (SELECT greatest(1.0, max(lex)) AS top FROM l), "
    "j AS (SELECT coalesce(l.id, v.id) AS id, lex, vec FROM l FULL JOIN v ON l.id = v.id) SELECT id, score, found_by FROM (SELECT id, round_even(CASE WHEN lex IS NOT NULL AND vec IS NOT NULL THEN least(1.0, 0.45 * lex / top + 0.55 * greatest(0, vec) + 0.1) ELSE 0.45 * coalesce(lex / top, 0) + 0.55 * greatest(0, coalesce(vec, 0)) END, 4)::DOUBLE AS score, concat_ws(',', CASE WHEN lex IS NOT NULL THEN 'lexical' END, CASE WHEN vec IS NOT NULL THEN 'vector' END) AS found_by FROM j, t) ORDER BY score DESC, id LIMIT 30"
)


@query(FUSED)
def hybrid_scores(spark, d):
    e = read(spark, d, "embeddings")
    asked = e.where("vec_id = 7").select("embedding").first()[0]
    vec = retrieval.cosine_top_k(e, list(asked), 1 << 30, "vec_id", "embedding")
    lex = read(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") / 10.0).alias("score"))
    return retrieval.fuse(lex, vec, 30)


@query("SELECT p_partkey, true AS unit, p_name = 'x' AS null_vector FROM part")
def embedding_norms(spark, d):
    """The pluggable hashing embedder: unit vectors, the same for the same text whatever its case and punctuation."""
    embed = retrieval.embedder(64)
    p = read(spark, d, "part").select("p_partkey", embed(F.col("p_name")).alias("a"), embed(F.upper(F.concat(F.col("p_name"), F.lit(" !")))).alias("b"))
    norm = F.sqrt(F.aggregate("a", F.lit(0.0), lambda s, x: s + x * x))
    return p.select("p_partkey", ((F.abs(norm - 1) < 1e-9) & (F.col("a") == F.col("b"))).alias("unit"), F.col("a").isNull().alias("null_vector"))


@query("SELECT p_brand AS key, count(*) AS n, min(p_size) AS first, max(p_size) AS last FROM part GROUP BY 1")
def service_registry(spark, d):
    """Verticals by name, each a function of the session: the one asked for answers, an unknown one is refused."""
    from tabloom.operators.registry import Registry

    r = Registry()
    r.add("parts", lambda: read(spark, d, "part").groupBy(F.col("p_brand").alias("key")).agg(F.count("*").alias("n"), F.min("p_size").alias("first"), F.max("p_size").alias("last")))
    return r.call("parts")


@query("SELECT event_type, count(*) AS calls, round(max(value), 4) AS slowest FROM events GROUP BY 1")
def operation_timings(spark, d):
    return metrics.timings(read(spark, d, "events"), "event_type", "value").select("event_type", "calls", F.round("slowest", 4).alias("slowest"))


# States, grants, hooks


@query("SELECT l_orderkey AS file, CASE WHEN list_contains(s, 'failed') AND (NOT list_contains(s, 'uploaded') OR list_position(s, 'failed') >= 1) THEN 'failed' WHEN NOT list_contains(s, 'uploaded') THEN 'unknown' WHEN NOT list_contains(s, 'parsed') THEN 'uploaded' WHEN NOT list_contains(s, 'indexed') THEN 'parsed' ELSE 'indexed' END AS state FROM (SELECT l_orderkey, list(DISTINCT CASE l_linenumber WHEN 1 THEN 'uploaded' WHEN 2 THEN 'parsed' WHEN 3 THEN 'indexed' WHEN 7 THEN 'failed' ELSE 'noise' END) AS s FROM lineitem GROUP BY 1)")
def ingest_states(spark, d):
    n = F.col("l_linenumber")
    e = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("file"), n.alias("at"), F.when(n == 1, "uploaded").when(n == 2, "parsed").when(n == 3, "indexed").when(n == 7, "failed").otherwise("noise").alias("s"))
    return lifecycle.ingest_states(e, "file", "s", ["at"])


@query("SELECT served, count(*) AS n FROM (SELECT ok AND row_number() OVER (PARTITION BY user_id, ok ORDER BY ts, event_id) = 1 AS served FROM (SELECT *, coalesce(ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12', false) AND user_id % 3 <> 0 AS ok FROM events)) GROUP BY 1")
def download_grants(spark, d):
    e = read(spark, d, "events").select("event_id", F.col("user_id").alias("token"), "ts")
    g = e.where("token % 3 <> 0").select("token").distinct().withColumn("granted", F.lit("2024-01-05").cast("timestamp_ntz"))
    return lifecycle.redeem(g, e, "token", "granted", "ts", 7 * 86400, ["ts", "event_id"]).groupBy("served").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT 'Market ' || p_brand || ' total' AS target, 'market ' || p_brand || ' totals' AS \"column\", 'similar' AS tier, true AS sure FROM part")
def similar_bindings(spark, d):
    """Names that are no other tier's: each goes to the column that is most like it, and not to its neighbours of another number."""
    b = read(spark, d, "part").select("p_brand").distinct()
    targets = b.select(say("Market ", "$p_brand", " total").alias("target"), F.lit(None).cast("string").alias("mergefield"))
    columns = b.select(say("market ", "$p_brand", " totals").alias("column"))
    found = resolution.tiered(targets, columns, b.where("false").select(F.col("p_brand").alias("target"), F.col("p_brand").alias("column")), least_cosine=0.75)
    return found.select("target", "column", "tier", F.col("confidence").between(0.75, 1.0).alias("sure"))


@query(TIER_SQL.format("'model'", "0.6", DIGIT + " NOT IN (1, 2, 3)"))
def matcher_hook(spark, d):
    """What the tiers leave open goes to a matcher; what it makes up is dropped."""
    targets, columns, known = tier_tables(spark, d)
    guess = lambda t, c: t.select("target", say("Col ", "$target").alias("column")).unionByName(t.select("target", F.lit("No such").alias("column")))
    return resolution.tiered(targets.select("target", "mergefield"), columns, known, guess).where("tier = 'model'")


@query("SELECT 'Column ' || c || ' holds ' || n || ' values and looks like ' || k || '.' AS text, c AS \"column\" FROM (SELECT 'c_name' AS c, count(*) AS n, 'text' AS k FROM customer UNION ALL SELECT 'c_acctbal', count(*), 'number' FROM customer)")
def column_texts(spark, d):
    return metrics.profile_texts(metrics.column_types(read(spark, d, "customer"), ["c_name", "c_acctbal"]))


@query("SELECT blocked, count(*) AS n FROM (SELECT o_orderstatus = 'P' AS blocked FROM orders) GROUP BY 1")
def generated_records(spark, d):
    """Resolved records with their lineage, written by state and read back."""
    from tabloom.sources import records

    U = resolution.Unit
    o = read(spark, d, "orders").withColumn("status_cell", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")))
    out = resolution.resolve(o, [U("status", "source", "status_cell")]).select("o_orderkey", "status", "lineage", "blocked")
    path = shared_path(spark, "generated")
    records.write_records(out, path, ["blocked"])
    back = spark.read.parquet(path).where(F.size("lineage") == 1)
    return back.groupBy(F.col("blocked").cast("boolean").alias("blocked")).agg(F.count("*").alias("n"))


@query("WITH n AS (SELECT n_nationkey AS k, n_regionkey AS c, n_nationkey % 3 AS b FROM nation), p AS (SELECT x.k AS a, y.k AS b, 0.8 + 0.2 * (x.b = y.b)::INTEGER AS s FROM n x JOIN n y ON x.k < y.k AND x.c = y.c), m AS (SELECT k, avg(s) AS s FROM (SELECT a AS k, s FROM p UNION ALL SELECT b, s FROM p) GROUP BY 1), c AS (SELECT k, min(k) OVER (PARTITION BY c) AS component FROM n) SELECT component, (SELECT k FROM m JOIN c c2 USING (k) WHERE c2.component = c.component ORDER BY round(m.s, 9) DESC, k LIMIT 1) AS medoid, count(*) AS members FROM c GROUP BY 1")
def cluster_medoids(spark, d):
    from tabloom.operators import clusters
    from tabloom.plans.texts import structural_pairs

    p = structural_pairs(spark, d).withColumn("score", F.round("score", 9))
    return clusters.medoids(p, clusters.components(p))


@query("SELECT p_size % 6 AS kind, p_size % 6 IN (0, 1, 3) AS material, count(*) AS n FROM part GROUP BY 1, 2")
def material_fields(spark, d):
    from tabloom.functions import scores

    k = F.col("p_size") % 6
    t = F.element_at(F.array(*[F.lit(x) for x in ("Currency", "identifier", "text", " amount ", "date", None)]), k + 1)
    return read(spark, d, "part").groupBy(k.alias("kind"), scores.is_material(t).alias("material")).agg(F.count("*").alias("n"))


@query("SELECT p_partkey, 'a' || p_size || ',b,c' AS inputs, CASE p_size % 3 WHEN 0 THEN 'BoolOp' WHEN 1 THEN 'Compare' END AS tree FROM part")
def language_readings(spark, d):
    """Inputs of a formula, and the tree of a condition that is in the language for two of three parts."""
    k = F.col("p_size") % 3
    rule = F.when(k == 0, say("a > ", "$p_size", " and b < 2")).when(k == 1, say("a > ", "$p_size")).otherwise(F.lit("open('x')"))
    return read(spark, d, "part").select("p_partkey", expressions.formula_inputs(say("max(a", "$p_size", ", b) * c - 1")).alias("inputs"), expressions.rule_reading(rule)["tree"].alias("tree"))


@query("SELECT p_partkey, round(round(p_retailprice / 7, 2) + abs(-p_size) + least(p_size, 9) + greatest(p_size, 9) + (p_size + 2 + 3) + (p_size + 4) / 2 + floor(p_size / 4) + ceil(p_size / 4) + sqrt(p_size), 6)::DOUBLE AS value FROM part")
def formula_functions(spark, d):
    from tabloom.operators import formulas

    f = formulas.formula("round(price / 7, 2) + abs(-n) + min(n, 9) + max(n, 9) + sum([n, 2, 3]) + mean(n, 4) + floor(n / 4) + ceil(n / 4) + sqrt(n)", {"price": F.col("p_retailprice"), "n": F.col("p_size")})
    return read(spark, d, "part").select("p_partkey", F.round(f["value"], 6).alias("value"))
