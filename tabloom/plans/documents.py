"""More queries: resolution, matching, lifecycle, coding, prose, privacy, streams."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tabloom.functions import dates, scores, text, values
from tabloom.operators import clusters, lab, lifecycle, metrics, privacy, resolution, retrieval, safety, text_checks, usage
from tabloom.operators.joins import shared_path
from tabloom.plans.catalogue import day, events, query, read
from tabloom.streaming import operators as streams


@query(
    "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'KEEP' ELSE 'REMOVE' END AS big_clause, round(o_totalprice * 0.1, 4) AS fee, CASE WHEN o_orderpriority = '5-LOW' THEN 'standard' ELSE o_orderpriority END AS priority, o_orderstatus = 'P' AS blocked "
    "FROM orders"
)
def resolve_manifest(spark, d):
    o = read(spark, d, "orders").withColumn("priority_cell", F.when(F.col("o_orderpriority") == "5-LOW", "n/a").otherwise(F.col("o_orderpriority"))).withColumn("status_cell", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")))
    U = resolution.Unit
    units = [U("big_clause", "conditional", "amount > 200000"), U("fee", "computed", "amount * 0.1"), U("amount", "source", "o_totalprice"), U("priority", "source", "priority_cell", "DEFAULT", "standard"), U("status", "source", "status_cell")]
    out = resolution.resolve(o, units)
    return out.select("o_orderkey", "big_clause", F.round(F.col("fee").cast("double"), 4).alias("fee"), "priority", "blocked")


@query()
def suggest_bindings(spark, d):
    targets = spark.createDataFrame([("customer_name", "string", False), ("account_balance", "currency", True), ("market_segment", "string", False), ("nation_key", "identifier", True)], "target string, declared_type string, material boolean")
    cols = metrics.column_types(read(spark, d, "customer"), ["c_name", "c_acctbal", "c_mktsegment", "c_nationkey"]).select(F.regexp_replace("column", "^c_", "").alias("column"), "observed_type")
    memory = spark.createDataFrame([("account_balance", "acctbal", 12)], "target string, column string, approvals int")
    return resolution.assign(resolution.suggest(targets, cols, memory, 0.4))


@query("SELECT p_mfgr AS target, p_type AS \"column\", count(*) FILTER (ev = 'approved') AS approvals, count(*) FILTER (ev = 'rejected') AS rejections, count(*) FILTER (ev = 'approved') - count(*) FILTER (ev = 'rejected') AS net FROM (SELECT p_brand AS p_mfgr, p_type, CASE WHEN p_size % 3 = 0 THEN 'rejected' ELSE 'approved' END AS ev FROM part) GROUP BY 1, 2")
def mapping_memory(spark, d):
    log = read(spark, d, "part").select(F.col("p_brand").alias("target"), F.col("p_type").alias("column"), F.when(F.col("p_size") % 3 == 0, "rejected").otherwise("approved").alias("event"))
    return resolution.mapping_memory(log)


@query("SELECT DISTINCT o_orderpriority AS value FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')")
def unmatched_values(spark, d):
    return resolution.unmatched_values(read(spark, d, "orders"), "o_orderpriority", ["1-urgent", "2-High"])


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'blocked' WHEN o_orderstatus = 'O' THEN 'changes_requested' WHEN o_orderpriority = '1-URGENT' THEN 'pending_review' ELSE 'draft' END AS status FROM orders")
def document_status(spark, d):
    s = lifecycle.document_status(F.col("o_orderkey") % 11 == 0, F.when(F.col("o_orderstatus") == "O", "open").otherwise("resolved"), F.col("o_orderpriority") == "1-URGENT")
    return read(spark, d, "orders").select("o_orderkey", s.alias("status"))


@query("SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS number FROM customer")
def gapless_numbers(spark, d):
    return lifecycle.gapless(read(spark, d, "customer"), "c_nationkey", ["c_custkey"]).select("c_custkey", F.col("number").cast("long").alias("number"))


@query("SELECT p_partkey, CASE WHEN r = 1 THEN p_type ELSE p_type || ' (' || r || ')' END AS unique_name FROM (SELECT p_partkey, p_type, row_number() OVER (PARTITION BY lower(p_type) ORDER BY p_partkey) AS r FROM part)")
def unique_names(spark, d):
    return lifecycle.unique_names(read(spark, d, "part"), "p_type", ["p_partkey"]).select("p_partkey", "unique_name")


@query("SELECT 'orders' AS \"table\", count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) UNION ALL SELECT 'customer', count(*) FROM customer WHERE c_acctbal >= 0")
def retention_sweep(spark, d):
    out = lifecycle.sweep(read(spark, d, "customer"), {"orders": (read(spark, d, "orders"), "o_custkey")}, "c_custkey", F.col("c_acctbal") < 0)
    n = lambda t, name: t.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n")
    return n(out["orders"], "orders").unionByName(n(out["parents"], "customer"))


@query("SELECT p_partkey, b = a OR (b, a) IN (('candidate', 'new'), ('candidate', 'refuted'), ('new', 'ongoing'), ('new', 'closed'), ('ongoing', 'closed'), ('closed', 'ongoing')) AS allowed FROM (SELECT p_partkey, ['candidate', 'new', 'ongoing', 'closed'][p_size % 4 + 1] AS b, ['candidate', 'new', 'ongoing', 'closed', 'refuted'][p_partkey % 5 + 1] AS a FROM part)")
def signal_transitions(spark, d):
    state = lambda c, *names: F.element_at(F.array(*[F.lit(n) for n in names]), (c + 1).cast("int"))
    moves = read(spark, d, "part").select("p_partkey", state(F.col("p_size") % 4, "candidate", "new", "ongoing", "closed").alias("before"), state(F.col("p_partkey") % 5, "candidate", "new", "ongoing", "closed", "refuted").alias("after"))
    return safety.check_transitions(moves).select("p_partkey", "allowed")


@query("SELECT l_orderkey AS case_id, max(l_linenumber) AS version, arg_max(l_shipmode, l_linenumber) AS mode FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 1 THEN CAST(l_quantity AS VARCHAR) END AS l_shipmode FROM (SELECT l_orderkey, l_linenumber, max(l_quantity) AS l_quantity FROM lineitem GROUP BY 1, 2)) GROUP BY 1")
def case_upsert(spark, d):
    log = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("version")).agg(F.max("l_quantity").alias("q"))
    log = log.withColumn("mode", F.when(F.col("version") % 2 == 1, F.col("q").cast("string")))
    return safety.upsert_cases(log, ["mode"]).select("case_id", "version", "mode")


@query("SELECT CAST(user_id AS VARCHAR) AS case_id, arg_min(event_type, event_id) AS first_term, count(*) AS events FROM events WHERE user_id % 7 <> 0 GROUP BY 1")
def line_listing_import(spark, d):
    rows = read(spark, d, "events").select(F.when(F.col("user_id") % 7 != 0, F.col("user_id").cast("string")).alias("case_id"), F.col("event_type").alias("first_term"), "event_id")
    out = safety.line_listing(rows, "case_id", ["first_term"], "first_term", "event_id")
    return out.select("case_id", "first_term", F.size("events").cast("long").alias("events"))


@query("SELECT event_type AS verbatim, CASE event_type WHEN 'click' THEN 'Interaction' WHEN 'view' THEN 'Interaction' WHEN 'purchase' THEN 'Sale' END AS coded_pt, count(*) AS n FROM events GROUP BY 1, 2")
def code_terms(spark, d):
    dictionary = spark.createDataFrame([("Click", "Interaction", "Use"), ("View", "Interaction", "Use"), ("Purchase", "Sale", "Trade")], "llt string, pt string, soc string")
    e = read(spark, d, "events").select(F.col("event_type").alias("verbatim"))
    return safety.code_terms(e, dictionary).groupBy("verbatim", "coded_pt").agg(F.count("*").alias("n"))


@query("SELECT l_suppkey, min(l_quantity) AS least, max(l_quantity) AS most, count(*) AS n FROM lineitem GROUP BY 1")
def observed_range(spark, d):
    r = read(spark, d, "lineitem").select("l_suppkey", "l_quantity", F.col("l_quantity").alias("t"))
    return lab.observed_range(r, ["l_suppkey"], "l_quantity", "t")


@query("SELECT l_partkey, l_returnflag, arg_min(l_orderkey * 10 + l_linenumber, (CASE WHEN l_linestatus = 'F' THEN 0 ELSE 1 END) * 10000000000 + l_orderkey * 10 + l_linenumber) AS picked FROM lineitem GROUP BY 1, 2")
def best_result_per_cell(spark, d):
    r = read(spark, d, "lineitem").select("l_partkey", "l_returnflag", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("picked"), F.when(F.col("l_linestatus") == "F", "v").alias("verified_by"))
    return lab.pick(r, ["l_partkey", "l_returnflag"], "verified_by", "picked").select("l_partkey", "l_returnflag", "picked")


@query("SELECT l_partkey, l_returnflag, count(DISTINCT CAST(l_quantity AS INTEGER)) AS texts FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT CAST(l_quantity AS INTEGER)) > 1")
def result_conflicts(spark, d):
    r = read(spark, d, "lineitem").select("l_partkey", "l_returnflag", F.concat(F.lit(" "), F.col("l_quantity").cast("int").cast("string"), F.lit("  ")).alias("t"))
    return lab.conflicts(r, ["l_partkey", "l_returnflag"], "t").select("l_partkey", "l_returnflag", F.size("texts").cast("long").alias("texts"))


@query("SELECT l_orderkey, sum(CAST(l_tax * 100 AS DECIMAL(18,6)))::DOUBLE AS total, abs(sum(CAST(l_tax * 100 AS DECIMAL(18,6))) - 100) <= 0.5 AS ok FROM lineitem GROUP BY 1")
def percent_totals(spark, d):
    f = read(spark, d, "lineitem").select("l_orderkey", (F.col("l_tax") * 100).alias("pct"))
    return lab.percent_totals(f, ["l_orderkey"], "pct").withColumn("total", F.col("total").cast("double"))


@query("SELECT p_partkey, (p_size * 1000)::DOUBLE AS mg, (p_size / 1000.0)::DOUBLE AS kg, (p_size * 10000)::DOUBLE AS ppm, CAST(NULL AS DOUBLE) AS across FROM part")
def unit_conversion(spark, d):
    n = F.col("p_size").cast(values.DECIMAL)
    conv = lambda a, b: values.convert(n, F.lit(a), F.lit(b)).cast("double")
    return read(spark, d, "part").select("p_partkey", conv("g", "mg").alias("mg"), conv("g", "kg").alias("kg"), conv("%", "mg/kg").alias("ppm"), conv("g", "mL").alias("across"))


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'day' WHEN 1 THEN 'month' ELSE 'year' END AS precision, CAST(CASE o_orderkey % 3 WHEN 0 THEN CAST(o_orderdate AS DATE) WHEN 1 THEN CAST(date_trunc('month', o_orderdate) AS DATE) ELSE CAST(date_trunc('year', o_orderdate) AS DATE) END AS VARCHAR) AS value FROM orders")
def partial_dates(spark, d):
    c = F.col("o_orderdate")
    t = F.when(F.col("o_orderkey") % 3 == 0, F.date_format(c, "yyyyMMdd")).when(F.col("o_orderkey") % 3 == 1, F.date_format(c, "yyyyMM")).otherwise(F.date_format(c, "yyyy"))
    return read(spark, d, "orders").select("o_orderkey", dates.parse_partial(t).alias("p")).select("o_orderkey", "p.precision", day(F.col("p.value")).alias("value"))


@query("SELECT c_custkey, regexp_replace(regexp_replace(lower(trim(c_name)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug, regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g') AS folded, 'id-' || c_custkey || '.pdf' AS file FROM customer")
def names_and_slugs(spark, d):
    return read(spark, d, "customer").select("c_custkey", text.slug(F.col("c_name")).alias("slug"), text.fold_name(F.col("c_name")).alias("folded"), text.safe_filename(F.concat(F.lit("id-"), F.col("c_custkey").cast("string"), F.lit(".pdf"))).alias("file"))


@query("SELECT p_partkey, round(0.55 * (CASE WHEN p_size <= 20 THEN 0.4 ELSE 0 END + 0.2 * (1 - abs(p_size - 10) / greatest(p_size, 10, 1)) + 0.2 + 0.2), 4)::DOUBLE AS similarity FROM part")
def structural_shape(spark, d):
    empty = F.array().cast("array<string>")
    one = lambda band, tables: F.struct(empty.alias("codes"), empty.alias("brackets"), band.alias("paragraph_band"), tables.alias("table_paragraphs"), F.lit(0).alias("blue_spans"), F.lit(0).alias("red_spans"))
    a, b = one(scores.count_band(F.col("p_size")), F.col("p_size")), one(F.lit(0), F.lit(10))
    return read(spark, d, "part").select("p_partkey", scores.structural_similarity(a, b).alias("similarity"))


@query("WITH RECURSIVE e AS (SELECT s_suppkey AS a, s_suppkey + 20 AS b FROM supplier WHERE s_suppkey + 20 IN (SELECT s_suppkey FROM supplier)), u AS (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e), r(node, other) AS (SELECT x, x FROM u UNION SELECT r.node, u.y FROM r JOIN u ON u.x = r.other) SELECT node, min(other) AS component FROM r GROUP BY 1")
def template_clusters(spark, d):
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("a"))
    e = s.withColumn("b", F.col("a") + 20).join(s.select(F.col("a").alias("b")), "b", "left_semi")
    return clusters.components(e)


@query("WITH q AS (SELECT vec_id AS q, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT q, vec_id AS id, list_cosine_similarity(embedding::DOUBLE[], qv) AS score FROM embeddings, q WHERE vec_id <> q), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS rank FROM s) SELECT q, id, rank, round(score, 8) AS score FROM r WHERE rank <= 5")
def nearest_vectors(spark, d):
    e = read(spark, d, "embeddings").select("vec_id", "embedding")
    out = retrieval.cosine_top_k_each(e.where("vec_id % 100 = 0"), e, 5, "vec_id", "embedding")
    return out.select("q", "id", F.col("rank").cast("long").alias("rank"), F.round("score", 8).alias("score"))


@query()
def sentence_chunks(spark, d):
    spark.udtf.register("sentence_chunks", retrieval.SentenceChunks)
    read(spark, d, "documents").createOrReplaceTempView("_tabloom_documents")
    return spark.sql("SELECT doc_id, c.part, length(c.text) AS chars FROM _tabloom_documents, LATERAL sentence_chunks(text, 700) c")


@query()
def paragraph_chunks(spark, d):
    spark.udtf.register("paragraph_chunks", retrieval.ParagraphChunks)
    read(spark, d, "documents").createOrReplaceTempView("_tabloom_documents")
    return spark.sql("SELECT doc_id, c.part, length(c.text) AS chars FROM _tabloom_documents, LATERAL paragraph_chunks(text, 2000, 1) c")


@query()
def pii_mask(spark, d):
    c = read(spark, d, "conversations")
    return c.select("conv_id", "turn", privacy.mask(F.col("text"), "salt").alias("masked"))


#: The shape-keeping redaction of a letter or digit at place i: a byte of the value's hash plus i, by digits or letters of its case.
BYTE_SQL = "(('0x' || h[(i % 32) * 2 + 1 : (i % 32) * 2 + 2])::INTEGER + i)"


@query(
    "WITH c AS (SELECT *, sha256('salt:c_name' || chr(0) || c_name) AS h FROM customer) SELECT c_custkey, c_mktsegment, array_to_string(list_transform(range(0, length(c_name)), lambda i: "
    f"CASE WHEN regexp_matches(c_name[i + 1], '[0-9]') THEN ({BYTE_SQL} % 10)::INTEGER::VARCHAR WHEN regexp_matches(c_name[i + 1], '[A-Z]') THEN chr((65 + {BYTE_SQL} % 26)::INTEGER) "
    f"WHEN regexp_matches(c_name[i + 1], '[a-z]') THEN chr((97 + {BYTE_SQL} % 26)::INTEGER) ELSE c_name[i + 1] END), '') AS c_name FROM c"
)
def redacted_customers(spark, d):
    c = read(spark, d, "customer")
    kinds = {n: privacy.classify_column(n, []) for n in ("c_name", "c_mktsegment")}
    return privacy.redact_record(c, kinds, "salt").select("c_custkey", "c_name", "c_mktsegment")


@query()
def hashed_embeddings(spark, d):
    return read(spark, d, "part").select("p_partkey", retrieval.embedder(64)(F.col("p_name")).alias("embedding"))


@query()
def uncited_numbers(spark, d):
    return text_checks.uncited_numbers(read(spark, d, "documents"), "doc_id", "text").groupBy("doc_id").agg(F.count("*").alias("sentences"))


@query(
    r"WITH u AS (SELECT unnest(list_filter(string_split_regex(text, '[^\p{L}\p{N}_]+'), lambda w: regexp_full_match(w, '[A-Z][A-Z0-9]{1,7}'))) AS acronym FROM documents), t AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]\s+\(([A-Z][A-Z0-9]{1,7})\)', 1)) AS acronym FROM documents) "
    "SELECT acronym, count(*) AS uses, acronym IN (SELECT acronym FROM t) AS expanded FROM u GROUP BY 1"
)
def abbreviations(spark, d):
    return text_checks.abbreviations(read(spark, d, "documents"), "text")


@query("SELECT event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS start, count(*) AS n FROM events GROUP BY 1, 2")
def stream_daily_counts(spark, d):
    """All files of the table as one stream, to its end."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    counts = stream.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
    path = shared_path(spark, "daily-counts")
    # A window's count may grow with every batch: each writes the whole result, as many rows as there are days and types.
    q = counts.writeStream.outputMode("complete").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path)).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema("start timestamp, event_type string, n long").parquet(path).select("event_type", F.date_format("start", "yyyy-MM-dd").alias("start"), "n")


@query("SELECT e.event_type AS model, count(*) AS calls, sum(CASE e.event_type WHEN 'click' THEN (user_id * 3 + event_id * 5) // 1000 WHEN 'view' THEN (user_id * 2 + event_id * 4) // 1000 END)::BIGINT AS cost_micro_usd FROM events e GROUP BY 1")
def metered_usage(spark, d):
    rates = spark.createDataFrame([("click", 3, 5), ("view", 2, 4)], "model string, rate_in long, rate_out long")
    calls = read(spark, d, "events").select(F.col("event_type").alias("model"), F.col("user_id").alias("input_tokens"), F.col("event_id").alias("output_tokens"))
    return streams.metered(calls, rates).groupBy("model").agg(F.count("*").alias("calls"), F.sum("cost_micro_usd").alias("cost_micro_usd"))


@query("""
WITH r AS (SELECT event_type AS model, date_trunc('day', ts) AS valid_from, max(user_id) AS rate_in, min(user_id) AS rate_out FROM events WHERE event_id % 7 = 0 GROUP BY 1, 2)
SELECT e.event_type AS model, count(*) AS calls, count(r.model) AS priced, sum((e.user_id * r.rate_in + e.event_id * r.rate_out) // 1000)::BIGINT AS cost_micro_usd
FROM events e ASOF LEFT JOIN r ON r.model = e.event_type AND e.ts >= r.valid_from GROUP BY 1
""")
def metered_by_date(spark, d):
    """Rates that change by the day, looked up as of each call."""
    e = read(spark, d, "events")
    rates = e.where("event_id % 7 = 0").groupBy(F.col("event_type").alias("model"), F.date_trunc("day", "ts").cast(e.schema["ts"].dataType).alias("valid_from")).agg(F.max("user_id").alias("rate_in"), F.min("user_id").alias("rate_out"))
    calls = e.select(F.col("event_type").alias("model"), "ts", F.col("user_id").alias("input_tokens"), F.col("event_id").alias("output_tokens"))
    found = streams.metered_by_date(calls, rates, "ts")
    return found.groupBy("model").agg(F.count("*").alias("calls"), F.count("rate_in").alias("priced"), F.sum("cost_micro_usd").alias("cost_micro_usd"))


@query("""
WITH c AS (SELECT *, 'Name: ' || c_name AS n, 'Contact: ' || CASE WHEN c_nationkey % 2 = 0 THEN '+49 30 ' || (1000000 + c_custkey) ELSE 'desk ' || c_custkey END AS p FROM customer)
SELECT c_custkey, 'Name: [NAME-' || substr(sha256('s' || n), 1, 4) || ']; Segment: ' || c_mktsegment || '; ' || CASE WHEN c_nationkey % 2 = 0 THEN 'Contact: [PHONE-' || substr(sha256('s' || p), 1, 4) || ']' ELSE p END || '; Mail: ; a note' AS chunk FROM c
""")
def chunks_redacted(spark, d):
    """What is personal is found in the chunks of each nation: a name by its key, a phone number by what all values look like."""
    k = F.col("c_custkey")
    contact = F.when(F.col("c_nationkey") % 2 == 0, F.concat(F.lit("+49 30 "), (k + 1000000).cast("string"))).otherwise(F.concat(F.lit("desk "), k.cast("string")))
    chunk = F.concat(F.lit("Name: "), "c_name", F.lit("; Segment: "), "c_mktsegment", F.lit("; Contact: "), contact, F.lit("; Mail: ; a note"))
    return privacy.redact_chunks(read(spark, d, "customer").select(k, "c_nationkey", chunk.alias("chunk")), "chunk", "c_nationkey", "s").select("c_custkey", "chunk")


@query("SELECT ts <= TIMESTAMP '2024-01-20' AS counted, count(*) AS n FROM events GROUP BY 1")
def data_lock_split(spark, d):
    before, after = streams.split_at_lock(read(spark, d, "events"), "ts", datetime(2024, 1, 20))
    n = lambda x, v: x.agg(F.count("*").alias("n")).select(F.lit(v).alias("counted"), "n")
    return n(before, True).unionByName(n(after, False))


@query("SELECT event_type, sum(value) IS NULL AS empty, count(*) AS n FROM events WHERE user_id % 10 = 3 AND event_type ILIKE '%c%' GROUP BY 1")
def tenant_search(spark, d):
    e = usage.search(usage.tenant_scope(events(spark, d), "3", "org"), "C", ["event_type"])
    return e.groupBy("event_type").agg(F.sum("value").isNull().alias("empty"), F.count("*").alias("n"))
