"""Queries over names, drafts and chunks: each text is built from a row, so that SQL can state what has to come out."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabloom.functions import dates, scores, values
from tabloom.functions import text as T
from tabloom.operators import lab, lifecycle, privacy, resolution, retrieval, text_checks
from tabloom.plans.catalogue import day, query, read
from tabloom.sources import records

say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) and not p.startswith("$") else F.col(p[1:]).cast("string") if isinstance(p, str) else p.cast("string") for p in parts])
STOP_SQL = "[" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + "]"


def part(spark, d):
    return read(spark, d, "part")


# Names


@query("SELECT p_partkey, 'fi' || p_name AS nfkc, trim(regexp_replace(lower(p_name || '__' || p_brand), '[^a-z0-9]+', ' ', 'g')) AS words, 'ug/' || replace(lower(p_type), ' ', '') AS unit, 'Part ' || p_name AS human, lower(p_brand) AS model FROM part")
def names_normalised(spark, d):
    model = say("Vendor/", "$p_brand", F.when(F.col("p_size") % 2 == 0, "-2024-05-06").otherwise("-20240506"))
    return part(spark, d).select(
        "p_partkey", T.nfkc(say("ﬁ", "$p_name")).alias("nfkc"), T.normalise_words(say("$p_name", "__", "$p_brand")).alias("words"), T.fold_unit(say(" µG / ", "$p_type")).alias("unit"),
        T.humanise(say("part_", F.translate("p_name", " ", "_"))).alias("human"), T.canonical_model(model).alias("model"),
    )


@query(
    f"SELECT p_partkey, array_to_string(list_filter(regexp_extract_all(lower(p_name || ' of the ' || p_brand), '[a-z0-9]+'), lambda w: NOT list_contains({STOP_SQL}, w)), ' ') AS ranked, array_to_string(list_filter(string_split_regex(lower(p_brand || '_' || p_type), '[^a-z0-9]+'), lambda w: w <> ''), ' ') AS named, "
    "greatest(1, length(p_name) // 4)::BIGINT AS tokens, round(CASE WHEN p_size % 2 = 0 THEN 2 / 3 ELSE 1 / 3 END, 6) AS overlap FROM part"
)
def names_tokens(spark, d):
    a, b = F.array("p_brand", "p_type"), F.when(F.col("p_size") % 2 == 0, F.array(F.col("p_type"), F.lit("x"), F.col("p_brand"))).otherwise(F.array(F.col("p_type"), F.lit("x")))
    return part(spark, d).select(
        "p_partkey", F.array_join(T.rank_tokens(say("$p_name", " of the ", "$p_brand")), " ").alias("ranked"), F.array_join(T.name_tokens(say("$p_brand", "_", "$p_type")), " ").alias("named"),
        T.estimate_tokens(F.col("p_name")).cast("long").alias("tokens"), F.round(scores.jaccard(a, b), 6).alias("overlap"),
    )


SECTION_SQL = "'14.' || (p_size % 12) || CASE WHEN p_size % 2 = 0 THEN '.3' ELSE '' END"


@query(f"SELECT p_partkey, id, id = '14.1' OR id LIKE '14.1.%' AS in_range, row_number() OVER (PARTITION BY p_brand ORDER BY list_transform(string_split(id, '.'), lambda x: x::INTEGER), p_partkey) AS place FROM (SELECT *, {SECTION_SQL} AS id FROM part)")
def section_order(spark, d):
    p = part(spark, d).withColumn("id", say("14.", F.col("p_size") % 12, F.when(F.col("p_size") % 2 == 0, ".3").otherwise("")))
    place = F.row_number().over(W.partitionBy("p_brand").orderBy(T.section_key(F.col("id")), "p_partkey"))
    return p.select("p_partkey", "id", T.in_id_range(F.col("id"), "14.1").alias("in_range"), place.cast("long").alias("place"))


@query(
    "SELECT p_partkey, p_type || ' - 2024-05-06 - ' || substr(lpad(p_partkey::VARCHAR, 12, '0'), 1, 8) || ' - en.docx' AS file, CASE WHEN p_size % 8 + 1 > 6 THEN 'a, b, c, d, e, f and ' || (p_size % 8 + 1 - 6) || ' more' ELSE array_to_string(['a', 'b', 'c', 'd', 'e', 'f', 'g', 'h'][1:p_size % 8 + 1], ', ') END AS listed, length(p_name) * 110.0::DOUBLE AS width FROM part"
)
def file_names(spark, d):
    names = F.slice(F.array(*[F.lit(c) for c in "abcdefgh"]), F.lit(1), F.col("p_size") % 8 + 1)
    ident = F.lpad(F.col("p_partkey").cast("string"), 12, "0")
    return part(spark, d).select("p_partkey", T.document_filename(F.col("p_type"), F.lit("2024-05-06").cast("date"), ident, F.lit("en"), "docx").alias("file"), T.capped_names(names).alias("listed"), T.width_estimate(F.col("p_name")).alias("width"))


@query("SELECT c_custkey, round(CASE WHEN k >= 8 THEN greatest(0.75, k / 18.0) ELSE k / 18.0 END, 6)::DOUBLE AS ratio FROM (SELECT c_custkey, 4 + c_custkey % 15 AS k FROM customer)")
def prefix_ratio(spark, d):
    c = read(spark, d, "customer")
    return c.select("c_custkey", F.round(T.fuzzy_ratio(F.col("c_name"), F.col("c_name").substr(F.lit(1), (4 + F.col("c_custkey") % 15).cast("int"))), 6).alias("ratio"))


@query("SELECT lang, count(*) FILTER (regexp_matches(text, '(^|[^A-Za-z0-9])(?i:the)($|[^A-Za-z0-9])')) AS said FROM documents GROUP BY 1")
def mentions_by_language(spark, d):
    return read(spark, d, "documents").groupBy("lang").agg(F.count_if(T.mentions(F.col("text"), "the")).alias("said"))


@query("SELECT p_partkey, 3::BIGINT AS n, 'Dr. ' || p_name || ' rose by 1.5 mg.' AS first, 'See e.g. Table 2.' AS second, 'No. ' || p_size || ' fell!' AS third FROM part")
def sentence_parts(spark, d):
    s = T.sentences(say("Dr. ", "$p_name", " rose by 1.5 mg. See e.g. Table 2. No. ", "$p_size", " fell!"))
    return part(spark, d).select("p_partkey", s.alias("s")).select("p_partkey", F.size("s").cast("long").alias("n"), *[F.get("s", F.lit(i)).alias(n) for i, n in enumerate(("first", "second", "third"))])


@query("SELECT p_size % 4 AS kind, count(*) FILTER (p_size % 4 IN (0, 1)) AS headings FROM part GROUP BY 1")
def headings(spark, d):
    t = F.when(F.col("p_size") % 4 == 0, say("3.1 ", "$p_name")).when(F.col("p_size") % 4 == 1, F.upper("p_name")).when(F.col("p_size") % 4 == 2, say("$p_name", " ends.")).otherwise(F.col("p_name"))
    return part(spark, d).groupBy((F.col("p_size") % 4).alias("kind")).agg(F.count_if(T.looks_like_heading(t)).alias("headings"))


@query("SELECT n_nationkey, ['책을', '나무를', '길을', '서울을'][n_nationkey % 4 + 1] AS object, ['책으로', '나무로', '길로', '서울로'][n_nationkey % 4 + 1] AS way FROM nation")
def particles(spark, d):
    word = F.element_at(F.array(*[F.lit(w) for w in ("책", "나무", "길", "서울")]), F.col("n_nationkey") % 4 + 1)
    return read(spark, d, "nation").select("n_nationkey", T.korean_particles(F.concat(word, F.lit("을(를)"))).alias("object"), T.korean_particles(F.concat(word, F.lit("으로(로)"))).alias("way"))


@query("SELECT p_partkey, 'equal:keep|delete:' || p_brand || '|insert:' || p_type || '|equal:end' AS changes FROM part")
def word_changes(spark, d):
    ops = T.word_diff(say("keep ", "$p_brand", " end"), say("keep ", "$p_type", " end"))
    return part(spark, d).select("p_partkey", F.array_join(F.transform(ops, lambda x: F.concat_ws(":", x["op"], x["text"])), "|").alias("changes"))


@query("SELECT p_partkey, (p_size % 2 = 0)::BIGINT AS units, 2::BIGINT AS placeholders, 1::BIGINT AS masks, (p_size % 3 = 0)::BIGINT AS instructions, (p_size % 7 = 0)::BIGINT AS doubled FROM part")
def prose_residue(spark, d):
    n = F.col("p_size")
    t = say("It was 5 ", F.when(n % 2 == 0, "% %").otherwise("%"), " of [Company Name] and «code» on xx/xx/xxxx.\n", F.when(n % 3 == 0, "Note to author: check").otherwise("Plain line"), " ", F.when(n % 7 == 0, "the the").otherwise("the"))
    of = {"units": T.doubled_units, "placeholders": T.placeholder_residue, "masks": T.fill_masks, "instructions": T.instruction_lines, "doubled": T.doubled_words}
    return part(spark, d).withColumn("t", t).select("p_partkey", *[F.size(f(F.col("t"))).cast("long").alias(k) for k, f in of.items()])


def drafts(spark, d):
    k = F.col("o_orderkey")
    content = say("Rate rose [S", k % 5 + 1, ", p.", k % 30, "] then [S2]. [DATA NEEDED: Dose ", k % 3, "] [DATA NEEDED: dose ", k % 3, "] [TABLE: 14.", k % 4, "]; Sex: F; 1,", F.lpad((k % 1000).cast("string"), 3, "0"), " patients were randomised.")
    return read(spark, d, "orders").select("o_orderkey", content.alias("content"))


@query("SELECT o_orderkey, 2::BIGINT AS n, 'S' || (o_orderkey % 5 + 1) AS marker, (o_orderkey % 30)::BIGINT AS page, 'Dose ' || (o_orderkey % 3) AS gap, '14.' || (o_orderkey % 4) AS tab, 'F' AS sex FROM orders")
def draft_markers(spark, d):
    x = drafts(spark, d).withColumn("c", T.citations(F.col("content")))
    first = lambda a: F.get(a, F.lit(0))
    return x.select("o_orderkey", F.size("c").cast("long").alias("n"), first(F.col("c"))["marker"].alias("marker"), first(F.col("c"))["page"].cast("long").alias("page"), first(T.data_needed(F.col("content"))).alias("gap"), first(T.table_markers(F.col("content"))).alias("tab"), T.field_value(F.col("content"), "Sex").alias("sex"))


@query("SELECT o_orderkey, (1000 + o_orderkey % 1000)::BIGINT AS n, 'randomised' AS what FROM orders")
def headline_numbers(spark, d):
    return text_checks.headline_counts(drafts(spark, d), "o_orderkey", "content").select("o_orderkey", "n", "what")


@query("SELECT o_orderkey, 'Dose ' || (o_orderkey % 3) AS gap FROM orders")
def declared_gaps(spark, d):
    return text_checks.data_needed(drafts(spark, d), "o_orderkey", "content").select("o_orderkey", "gap")


@query("SELECT o_orderkey, '14.' || (o_orderkey % 4) AS \"table\" FROM orders WHERE o_orderkey % 4 NOT IN (1, 2)")
def unknown_tables(spark, d):
    return text_checks.unknown_tables(drafts(spark, d), "o_orderkey", "content", ["14.1", "14.2"])


@query("SELECT c_custkey, 'c_name|c_mktsegment' AS fields, c_name || '|' || c_mktsegment || '|x' AS cells, CASE c_custkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS flag FROM customer")
def chunk_parts(spark, d):
    flag = F.when(F.col("c_custkey") % 3 == 0, " Yes ").when(F.col("c_custkey") % 3 == 1, "no").otherwise("maybe")
    return read(spark, d, "customer").select("c_custkey", F.array_join(T.chunk_fields(T.record_text(["c_name", "c_mktsegment"])), "|").alias("fields"), F.array_join(T.split_cell(say("$c_name", "; ", "$c_mktsegment", " , x/")), "|").alias("cells"), dates.parse_flag(flag).alias("flag"))


# Checks of drafts


@query("SELECT 'the' AS word, n, t AS in_template, n - t AS extra FROM (SELECT count(*) FILTER (o_orderkey % 10 = 0) AS n FROM orders), (SELECT count(*) AS t FROM nation) WHERE n > t")
def doublings_beyond_template(spark, d):
    o = read(spark, d, "orders").select(F.when(F.col("o_orderkey") % 10 == 0, "see the The end").otherwise("so that that is").alias("t"))
    return text_checks.word_doublings(o, read(spark, d, "nation").select(F.lit("of the the").alias("t")), "t").select("word", "n", "in_template", "extra")


@query("SELECT c_nationkey AS doc, c_name AS value FROM customer WHERE c_custkey % 5 = 0")
def lost_values(spark, d):
    c = read(spark, d, "customer").select(F.col("c_nationkey").alias("doc"), F.col("c_name").alias("value"), "c_custkey")
    told = c.select("doc", F.when(F.col("c_custkey") % 5 != 0, say("It is  ", "$value", " ")).otherwise("None").alias("text"))
    return text_checks.lost_values(c.drop("c_custkey"), told, "doc", "value", "text")


@query("SELECT c_custkey, c_mktsegment, max_len FROM customer JOIN (VALUES ('FURNITURE', 18), ('BUILDING', 19)) l(s, max_len) ON s = c_mktsegment WHERE 18 + c_custkey % 3 > max_len")
def too_long(spark, d):
    limits = spark.createDataFrame([("FURNITURE", 18), ("BUILDING", 19)], "c_mktsegment string, max_len int")
    v = read(spark, d, "customer").withColumn("v", F.concat("c_name", F.expr("repeat('x', int(c_custkey % 3))")))
    return text_checks.too_long(v, limits, "c_mktsegment", "v").select("c_custkey", "c_mktsegment", "max_len")


@query("SELECT claim, count(*) AS n FROM (SELECT 'USP <' || p_size || '>' AS claim FROM part UNION ALL SELECT 'Ph. Eur.' FROM part) GROUP BY 1")
def compendial_claims(spark, d):
    p = part(spark, d).select("p_partkey", say("Tested per USP <", "$p_size", "> and Ph. Eur. 2.2").alias("t"))
    return text_checks.compendial_claims(p, "p_partkey", "t").groupBy("claim").agg(F.count("*").alias("n"))


@query("SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'blocker' WHEN '5-LOW' THEN 'info' ELSE 'warning' END AS severity, count(*) AS n FROM orders GROUP BY 1")
def policy_routing(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderpriority").alias("code"), F.lit("warning").alias("severity"), F.col("o_orderkey").cast("string").alias("message"))
    policy = spark.createDataFrame([("1-URGENT", "blocker"), ("5-LOW", "info")], "code string, severity string")
    return text_checks.route(o, policy).groupBy("severity").agg(F.count("*").alias("n"))


@query("SELECT * FROM (SELECT l_orderkey, count(*) FILTER (l_linenumber = 1) AS kept, count(*) FILTER (l_linenumber = 7) AS undecided FROM lineitem GROUP BY 1) WHERE kept <> 1 OR undecided > 0")
def branch_faults(spark, d):
    v = read(spark, d, "lineitem").select("l_orderkey", F.when(F.col("l_linenumber") == 1, "KEEP").when(F.col("l_linenumber") == 7, "UNDECIDED").otherwise("REMOVE").alias("verdict"))
    return text_checks.branch_counts(v, "l_orderkey")


@query("SELECT 'DUPLICATE_ID' AS code, p_brand AS what FROM part GROUP BY p_brand HAVING count(*) > 1 UNION ALL SELECT DISTINCT 'MISSING_REFERENCE', p_type FROM part WHERE p_type NOT IN (SELECT p_brand FROM part)")
def manifest_faults(spark, d):
    return text_checks.manifest_faults(part(spark, d).select(F.col("p_brand").alias("id"), F.array("p_brand", "p_type").alias("refers_to")))


@query("SELECT doc_id FROM documents WHERE len(string_split_regex(trim(text), '\\s+')) > 40 AND NOT regexp_matches(text, '\\[S\\d+')")
def uncited_drafts(spark, d):
    return text_checks.uncited_drafts(read(spark, d, "documents"), "doc_id", "text")


@query("SELECT CASE WHEN l_suppkey % 3 = 0 THEN 'CITATION_UNRESOLVED' WHEN l_linenumber % 3 = 2 THEN 'NOT_IN_SOURCE' ELSE 'VERIFIED' END AS outcome, count(*) AS n FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier) GROUP BY 1")
def cited_values(spark, d):
    n = F.col("l_linenumber") % 3
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"))
    cited = read(spark, d, "lineitem").join(s, "l_suppkey", "left_semi").select(say("S", "$l_suppkey").alias("marker"), F.when(n == 0, "7").when(n == 1, "1,250.5").otherwise("99").alias("number"))
    chunks = s.where("l_suppkey % 3 <> 0").select(say("S", "$l_suppkey").alias("marker"), F.lit("Values 7, 12 and 1,250.50 mg").alias("text"))
    return text_checks.citation_values(cited, chunks).groupBy("outcome").agg(F.count("*").alias("n"))


@query("SELECT l_partkey AS concept, count(DISTINCT l_linestatus) AS \"values\", count(DISTINCT l_returnflag) AS sections FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linestatus) > 1")
def cross_section_counts(spark, d):
    c = read(spark, d, "lineitem").select(F.col("l_partkey").alias("concept"), F.col("l_linestatus").alias("value"), F.col("l_returnflag").alias("section"))
    return text_checks.cross_section(c, "concept", "value", "section").select("concept", F.size("values").cast("long").alias("values"), F.size("sections").cast("long").alias("sections"))


@query("SELECT * FROM (SELECT 'AE' AS acronym, 2 * count(*) FILTER (p_size % 2 = 0) AS uses, true AS expanded FROM part UNION ALL SELECT 'PK7', count(*) FILTER (p_size % 2 = 0), false FROM part UNION ALL SELECT 'SAE', count(*) FILTER (p_size % 2 = 1), false FROM part)")
def undefined_abbreviations(spark, d):
    t = F.when(F.col("p_size") % 2 == 0, "an adverse event (AE) of PK7 and AE").otherwise("an SAE here")
    return text_checks.abbreviations(part(spark, d).select(t.alias("t")), "t")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'Dose was 5 mg.' ELSE 'It was 9 of ' || (o_orderkey % 100) || '.' END AS sentence FROM orders")
def uncited_sentences(spark, d):
    t = F.when(F.col("o_orderkey") % 2 == 0, "Dose was 5 mg. Rate was 7 [S1]. None here.").otherwise(say("No numbers. It was 9 of ", F.col("o_orderkey") % 100, "."))
    return text_checks.uncited_numbers(read(spark, d, "orders").select("o_orderkey", t.alias("t")), "o_orderkey", "t").select("o_orderkey", "sentence")


# Chunks


def _chunked(spark, d, name, udtf, text, arguments, columns):
    spark.udtf.register(name, udtf)
    part(spark, d).select("p_partkey", text.alias("t")).createOrReplaceTempView(f"_{name}")
    return spark.sql(f"SELECT p_partkey, {columns} FROM _{name}, LATERAL {name}(t, {arguments}) c")


@query("SELECT p_partkey, i::INTEGER AS part, CASE i WHEN 0 THEN 'Alpha one. Beta two' ELSE 'Item ' || lpad(p_partkey::VARCHAR, 6, '0') || '.' END AS text FROM part, range(2) r(i)")
def sentence_budget(spark, d):
    return _chunked(spark, d, "sentence_budget", retrieval.SentenceChunks, say("Alpha one. Beta two. Item ", F.lpad(F.col("p_partkey").cast("string"), 6, "0"), "."), "20", "c.part, c.text")


@query("SELECT p_partkey, i::INTEGER AS part, CASE i WHEN 0 THEN k || chr(10) || 'bbbb' WHEN 1 THEN 'bbbb' || chr(10) || 'cccc' ELSE 'cccc' || chr(10) || 'dddd' END AS text FROM (SELECT p_partkey, lpad((p_partkey % 10000)::VARCHAR, 4, '0') AS k FROM part), range(3) r(i)")
def paragraph_budget(spark, d):
    return _chunked(spark, d, "paragraph_budget", retrieval.ParagraphChunks, say(F.lpad((F.col("p_partkey") % 10000).cast("string"), 4, "0"), "\nbbbb\n\ncccc\ndddd"), "8, 1", "c.part, c.text")


@query("SELECT p_partkey, i::INTEGER AS part, 2::INTEGER AS \"of\", CASE i WHEN 1 THEN 'h' || chr(10) || 'r1' || chr(10) || 'r2' ELSE 'h' || chr(10) || 'r3' END AS text FROM part, range(1, 3) r(i)")
def table_parts(spark, d):
    return _chunked(spark, d, "table_parts", retrieval.TableChunks, F.lit("h\nr1\nr2\n\nr3"), "5", "c.part, c.of, c.text")


@query("SELECT p_partkey, i::INTEGER AS part, CASE i WHEN 0 THEN k ELSE k[5:8] || chr(10) || chr(10) || 'bbbbbbbb' || chr(10) || chr(10) || 'cc' END AS text, CASE i WHEN 0 THEN 2 ELSE 4 END::INTEGER AS tokens FROM (SELECT p_partkey, lpad(p_partkey::VARCHAR, 8, '0') AS k FROM part), range(2) r(i)")
def narrative_overlap(spark, d):
    return _chunked(spark, d, "narrative_overlap", retrieval.NarrativeChunks, say(F.lpad(F.col("p_partkey").cast("string"), 8, "0"), "\n\nbbbbbbbb\n\ncc"), "3, 1", "c.part, c.text, c.tokens")


@query("SELECT p_partkey, 'S' || row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_size, p_partkey) AS marker FROM part")
def numbered_extracts(spark, d):
    return retrieval.numbered_extracts(part(spark, d), ["p_size", "p_partkey"], "p_name", ["p_brand", "p_type"]).select("p_partkey", "marker")


BLOCKS_SQL = r"""list_filter(list_transform(string_split(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(?:script|style|noscript)\b.*?</(?:script|style|noscript)\s*>|<!--.*?-->', ' ', 'g'), '(?i)</?(?:p|div|br|li|ul|ol|tr|td|th|table|h[1-6]|section|article|header|footer|nav|title|body|head|html)\b[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), chr(10)), lambda x: trim(regexp_replace(x, '[ \t\r]+', ' ', 'g'))), lambda x: x <> '')"""


@query(f"SELECT page_id AS id, generate_subscripts(b, 1) - 1 AS part, unnest(b) AS text FROM (SELECT page_id, {BLOCKS_SQL} AS b FROM pages)")
def html_chunks(spark, d):
    return records.chunks_html(read(spark, d, "pages"), "page_id", "html").select("id", F.col("part").cast("long").alias("part"), "text")


@query("SELECT event_id AS id, 'k: ' || CAST(json_extract(props, '$.k') AS VARCHAR) AS text FROM events")
def json_chunks(spark, d):
    return records.chunks_json(read(spark, d, "events"), "event_id", "props", "k long").select("id", "text")


# Dates and numbers


@query(
    "SELECT o_orderkey, CAST(make_date(CASE WHEN y < 70 THEN 2000 + y ELSE 1900 + y END, 3, 5) AS VARCHAR) AS pivoted, round(a * [10, 1, 1 / 12, 1 / 52.1775, 1 / 365.25, 1 / 8766][u + 1], 8)::DOUBLE AS years, CAST(CAST(o_orderdate - INTERVAL 30 DAY AS DATE) AS VARCHAR) AS kept_from, "
    "strftime(o_orderdate, '%d.%m.%Y') AS german, strftime(o_orderdate, '%Y/%m/%d') AS japanese FROM (SELECT *, CAST(o_orderkey % 100 AS INTEGER) AS y, o_orderkey % 90 AS a, CAST(o_orderkey % 6 AS INTEGER) AS u FROM orders)"
)
def date_scalars(spark, d):
    k = F.col("o_orderkey")
    unit = F.element_at(F.array(*[F.lit(u) for u in ("800", "801", "802", "803", "804", "805")]), (k % 6 + 1).cast("int"))
    return read(spark, d, "orders").select(
        "o_orderkey", day(dates.parse_ordered(say("5-Mar-", F.lpad((k % 100).cast("string"), 2, "0")))["value"]).alias("pivoted"), F.round(dates.age_in_years((k % 90).cast("string"), unit), 8).alias("years"),
        day(lifecycle.before(F.col("o_orderdate"), 30)).alias("kept_from"), dates.format_locale(F.col("o_orderdate"), "de").alias("german"), dates.format_locale(F.col("o_orderdate"), "ja_JP").alias("japanese"),
    )


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS utc FROM events")
def naive_moments(spark, d):
    return read(spark, d, "events").select("event_id", F.date_format(dates.naive_utc(F.col("ts")), "yyyy-MM-dd HH:mm:ss").alias("utc"))


@query(
    "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 0.0 WHEN 1 THEN p_size WHEN 2 THEN p_size * 12 ELSE p_size / 4.0 END::DOUBLE AS months, CASE p_size % 4 WHEN 0 THEN 'Initial' WHEN 1 THEN p_size || CASE WHEN p_size = 1 THEN ' month' ELSE ' months' END END AS label, "
    "CASE p_size % 4 WHEN 0 THEN '40C/75RH' WHEN 1 THEN '25C/60RH' WHEN 2 THEN '5C' ELSE '-20C' END AS condition FROM part"
)
def stability_terms(spark, d):
    n = F.col("p_size") % 4
    t = F.when(n == 0, "Initial").when(n == 1, say("$p_size", " months")).when(n == 2, say("$p_size", " years")).otherwise(say("$p_size", " weeks"))
    c = F.when(n == 0, "Accelerated storage").when(n == 1, "25°C / 60% RH").when(n == 2, "refrigerated").otherwise("-20 °C")
    m = dates.timepoint(t)
    return part(spark, d).select("p_partkey", m.alias("months"), F.when(n < 2, dates.timepoint_label(m)).alias("label"), dates.storage_condition(c).alias("condition"))


@query(
    "SELECT p_partkey, (1000 + p_size + 0.5)::DOUBLE AS number, p_size || '%' AS pct, format('{:,.2f}', 1000 + p_size + 0.25) || ' mg' AS quantity, CASE WHEN p_size % 2 = 0 THEN '-' ELSE '' END || '$' || format('{:,.2f}', 1000 + p_size + 0.25) AS money, '1.' || lpad(p_size::VARCHAR, 3, '0') || ',25 €' AS german, "
    "(1000 + p_size)::VARCHAR || '.5' AS plain, (p_size * 1.5)::DOUBLE AS usd, (1003 + p_size)::DOUBLE AS total FROM part"
)
def number_scalars(spark, d):
    n = F.col("p_size")
    grouped = say("1,", F.lpad(n.cast("string"), 3, "0"), ".50")
    rows = part(spark, d).withColumns({"a": grouped, "b": F.lit(" 2.5 ")})
    signed = F.when(n % 2 == 0, -(1000.25 + n)).otherwise(1000.25 + n)
    return rows.select(
        "p_partkey", values.as_number(F.col("a")).alias("number"), values.format_percent(n / 100).alias("pct"), values.format_quantity(1000.25 + n, 2, "mg").alias("quantity"), values.format_currency(signed).alias("money"), values.format_money(1000.25 + n, "€", "de").alias("german"),
        T.normalise_number(F.col("a")).alias("plain"), values.usd(n * 1_500_000).alias("usd"), lab.row_totals(rows, ["a", "b"]).cast("double").alias("total"),
    )


# Structures, types, bindings


STRUCTURE_SQL = "0.3 * (CASE WHEN p_size <= 20 THEN 0.4 ELSE 0 END + 0.2 * (1 - abs(p_size % 5 - 2) / greatest(p_size % 5, 2, 1)) + 0.4) + CASE WHEN p_brand = 'Brand#13' THEN 0.5 ELSE 0 END + 0.2"


@query(f"SELECT p_partkey, round(s, 4)::DOUBLE AS similarity, CASE WHEN round(s, 4) >= 0.9 THEN 'REUSE_MANIFEST' WHEN round(s, 4) >= 0.6 THEN 'REUSE_EVIDENCE' ELSE 'NEW_FAMILY' END AS decision FROM (SELECT p_partkey, {STRUCTURE_SQL} AS s FROM part)")
def structural_families(spark, d):
    n = F.col("p_size")
    a = scores.structural_fingerprint(F.array("p_brand"), F.array(F.lit("[Name] of [ DATE ]"), F.lit("plain")), n, n % 5, F.lit(0), F.lit(0))
    b = scores.structural_fingerprint(F.array(F.lit("Brand#13")), F.array(F.lit("by [name], [date]")), F.lit(10), F.lit(2), F.lit(0), F.lit(0))
    return part(spark, d).select("p_partkey", scores.structural_similarity(a, b).alias("similarity")).withColumn("decision", scores.family_decision(F.col("similarity")))


@query("WITH n AS (SELECT n_nationkey AS k, n_regionkey AS c, n_nationkey % 3 AS b FROM nation) SELECT x.k AS a, y.k AS b, round(0.3 + 0.5 * (x.c = y.c)::INTEGER + 0.2 * (x.b = y.b)::INTEGER, 4)::DOUBLE AS score FROM n x JOIN n y ON x.k < y.k AND x.c = y.c")
def structural_pairs(spark, d):
    shape = scores.structural_fingerprint(F.array(say("r", "$n_regionkey")), F.array(say("[b", F.col("n_nationkey") % 3, "]")), F.lit(10), F.lit(0), F.lit(0), F.lit(0))
    return scores.similar_pairs(read(spark, d, "nation").withColumn("shape", shape), "n_nationkey", "shape", 0.6)


@query("SELECT p_size % 5 AS kind, CASE p_size % 5 WHEN 1 THEN 'MISMATCH' WHEN 4 THEN 'UNKNOWN' ELSE 'COMPATIBLE' END AS verdict, count(*) AS n FROM part GROUP BY 1, 2")
def type_matches(spark, d):
    n = F.col("p_size") % 5
    pick = lambda *w: F.element_at(F.array(*[F.lit(x) for x in w]), n + 1)
    v = scores.compare_types(pick("currency", "date", "text", "identifier", "blob"), pick("float", "string", "date", "int", "int"))
    return part(spark, d).groupBy(n.alias("kind"), v.alias("verdict")).agg(F.count("*").alias("n"))


@query("SELECT CASE p_size % 3 WHEN 0 THEN 'rejected' WHEN 1 THEN 'accepted' ELSE 'edited' END AS decision, count(*) AS n FROM part GROUP BY 1")
def reviewer_decisions(spark, d):
    n = F.col("p_size") % 3
    return part(spark, d).groupBy(resolution.reviewer_decision(F.col("p_brand"), F.when(n == 1, F.col("p_brand")).when(n == 2, F.col("p_type"))).alias("decision")).agg(F.count("*").alias("n"))


@query("SELECT c_name AS name, CASE c_mktsegment WHEN 'BUILDING' THEN 'B' WHEN 'FURNITURE' THEN 'F' ELSE c_mktsegment END AS segment FROM customer")
def bound_records(spark, d):
    return resolution.apply_binding(read(spark, d, "customer"), {"name": "c_name", "segment": "c_mktsegment"}, {"segment": {"BUILDING": "B", " furniture": "F"}})


@query("SELECT p_type AS field, array_to_string(list_sort(list(DISTINCT p_brand)), ',') AS permitted FROM part GROUP BY 1")
def permitted_values(spark, d):
    return records.permitted_values(part(spark, d), "p_type", "p_brand").select(F.col("p_type").alias("field"), F.array_join("permitted", ",").alias("permitted"))


@query("SELECT p_partkey, lower(p_type) AS shared, lower(p_brand) || ',x' AS lacking, p_brand || ',' || p_type AS seen FROM part")
def term_sets(spark, d):
    a, b = F.array(F.col("p_brand"), F.col("p_type"), F.lit("X")), F.array(F.lower("p_type"), F.lit("y"))
    twice = F.array(F.col("p_brand"), F.lit(" "), F.col("p_type"), F.col("p_brand"))
    return part(spark, d).select("p_partkey", F.array_join(T.shared_terms(a, b), ",").alias("shared"), F.array_join(T.lacking_terms(a, b), ",").alias("lacking"), F.array_join(T.in_order(twice), ",").alias("seen"))


# Personal data: the spans come from privacy.detect, SQL states what was put in


@query("SELECT c_custkey, 'email' AS kind, 'c' || c_custkey || '@mail.example.org' AS text FROM customer UNION ALL SELECT c_custkey, 'phone', '+44 20 7946 ' || lpad((c_custkey % 10000)::VARCHAR, 4, '0') FROM customer UNION ALL SELECT c_custkey, 'reporter_name', 'Jane Smith' FROM customer UNION ALL SELECT c_custkey, 'site_name', 'Royal Mercy Hospital' FROM customer "
       "UNION ALL SELECT c_custkey, 'date_of_birth', '12 March 1970' FROM customer UNION ALL SELECT c_custkey, 'national_id', 'QQ' || lpad(c_custkey::VARCHAR, 7, '0') FROM customer UNION ALL SELECT c_custkey, 'address', (1 + c_custkey % 90) || ' High Street' FROM customer UNION ALL SELECT c_custkey, 'patient_name', 'Alan Reed' FROM customer")  # fmt: skip
def pii_kinds(spark, d):
    k = F.col("c_custkey")
    t = say("Dr. Jane Smith of the Royal Mercy Hospital wrote from c", k, "@mail.example.org, phone +44 20 7946 ", F.lpad((k % 10000).cast("string"), 4, "0"), ". Passport number QQ", F.lpad(k.cast("string"), 7, "0"), ", born on 12 March 1970, lives at ", 1 + k % 90, " High Street. Adverse Event: told by Alan Reed.")
    return read(spark, d, "customer").select("c_custkey", F.explode(privacy.detect(t)).alias("s")).select("c_custkey", "s.kind", "s.text")


@query("SELECT conv_id, turn, text AS masked FROM conversations WHERE NOT regexp_matches(text, '[0-9@]') AND NOT regexp_matches(text, '(?i)(?:^|[^\\p{L}\\p{N}_])(dr|doctor|prof|professor|mr|mrs|ms|miss|sr|sra|herr|frau|hospitals?|clinic|clinique|klinik|infirmary|surgery|practice|institute|university|universit[aä]t|trust|pharmacy|street|st|road|rd|avenue|ave|lane|ln|drive|close|court|crescent|way|place|terrace|boulevard|blvd|centre|center)(?:$|[^\\p{L}\\p{N}_])')")
def pii_mask_leaves_clean_text(spark, d):
    c = read(spark, d, "conversations").where(~F.col("text").rlike(privacy.MAYBE))
    return c.select("conv_id", "turn", privacy.mask(F.col("text"), "salt").alias("masked"))


@query("SELECT c_custkey, 'c_name: [NAME-' || substr(sha256('salt' || 'c_name: ' || c_name), 1, 4) || ']; c_mktsegment: ' || c_mktsegment AS chunk FROM customer")
def redacted_chunks(spark, d):
    c = read(spark, d, "customer")
    kinds = {n: privacy.classify_column(n, []) for n in ("c_name", "c_mktsegment")}
    return c.select("c_custkey", privacy.redact_chunk(T.record_text(["c_name", "c_mktsegment"]), kinds, "salt").alias("chunk"))


@query("SELECT c_custkey, length(c_name) AS n, regexp_replace(regexp_replace(regexp_replace(c_name, '[0-9]', '9', 'g'), '[A-Z]', 'A', 'g'), '[a-z]', 'a', 'g') AS shape, true AS other FROM customer")
def redaction_keeps_shape(spark, d):
    c = read(spark, d, "customer").select("c_custkey", "c_name", privacy.redact(F.col("c_name"), "salt").alias("r"))
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace("r", "[0-9]", "9"), "[A-Z]", "A"), "[a-z]", "a")
    return c.select("c_custkey", F.length("r").cast("long").alias("n"), shape.alias("shape"), (F.col("r") != F.col("c_name")).alias("other"))


# Lookups that a condition or formula states


@query("SELECT p_partkey, true AS same, true AS apart, (SELECT count(DISTINCT p_size) FROM part) AS rules FROM part")
def expression_hashes(spark, d):
    """Two spellings of each part's rule have one hash, another bound has another, and there are as many hashes as rules."""
    from tabloom.operators import expressions

    h = lambda *parts: expressions.rule_reading(say(*parts))["hash"]
    p = part(spark, d).select("p_partkey", h("amount > ", "$p_size", " AND kind in ['a']").alias("a"), h("(amount > ", "$p_size", ") and (kind in ['a'])").alias("b"), h("amount > ", F.col("p_size") + 1, " and kind in ['a']").alias("c"))
    n = p.agg(F.countDistinct("a").alias("rules"))
    return p.join(F.broadcast(n), F.lit(True)).select("p_partkey", (F.col("a") == F.col("b")).alias("same"), (F.col("a") != F.col("c")).alias("apart"), "rules")


@query("SELECT n_nationkey, name, origin FROM nation, LATERAL (VALUES ('amount' || n_nationkey, 'field'), ('fee', 'formula'), ('status', 'condition'), ('rate' || n_regionkey, 'formula')) v(name, origin)")
def bindable_targets(spark, d):
    """The targets of a manifest for each nation."""
    from tabloom.operators import expressions

    amount, rate = say("amount", "$n_nationkey"), say("rate", "$n_regionkey")
    manifest = F.to_json(F.struct(
        F.array(F.struct(amount.alias("id"), F.lit("field").alias("kind"), F.array().cast("array<string>").alias("inputs")), F.struct(F.lit("fee").alias("id"), F.lit("computed").alias("kind"), F.array(amount, rate).alias("inputs"))).alias("fields"),
        F.array(F.struct(say("status == 'P' and ", amount, " > 5").alias("expression"))).alias("conditions"),
    ))
    return read(spark, d, "nation").select("n_nationkey", F.explode(expressions.bindable_of(manifest)).alias("t")).select("n_nationkey", "t.name", "t.origin")



@query("SELECT o_orderkey::VARCHAR AS section, 'UNCITED_NUMBER' AS code, 'warning' AS severity, 'It was 9.' AS message FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey::VARCHAR, 'DATA_NEEDED', 'blocker', 'dose' FROM orders WHERE o_orderkey % 2 = 1 UNION ALL SELECT o_orderkey::VARCHAR, 'TABLE_UNKNOWN', 'blocker', 'T9' FROM orders WHERE o_orderkey % 2 = 1")
def section_bundle(spark, d):
    t = F.when(F.col("o_orderkey") % 2 == 0, "All well. It was 9. See [TABLE: T1]").otherwise("Nothing said [DATA NEEDED: dose] [TABLE: T9] [TABLE: T1]")
    return text_checks.section_findings(read(spark, d, "orders").select("o_orderkey", t.alias("t")), "o_orderkey", "t", ["T1"])


@query("SELECT l_orderkey AS field, count(*) AS slots FROM lineitem GROUP BY 1 HAVING bool_and(l_linestatus = 'F')")
def orphaned_fields(spark, d):
    li = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("field"), F.col("l_linestatus").alias("paragraph"))
    return text_checks.orphaned_fields(li, li.where("paragraph = 'F'"), "field", "paragraph")


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_brand || '|2' END AS members FROM part")
def json_lists(spark, d):
    t = F.when(F.col("p_size") % 3 == 0, "no list").otherwise(say('["', "$p_brand", '", 2]'))
    return part(spark, d).select("p_partkey", F.array_join(T.json_list(t), "|").alias("members"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 <> 0 THEN 1 END::INTEGER AS place FROM part")
def header_rows(spark, d):
    row = lambda *c: F.array(*[F.lit(x) if isinstance(x, str) else x for x in c])
    rows = F.array(row(F.col("p_name"), "x"), F.when(F.col("p_size") % 3 != 0, row("Test", "Limit")).otherwise(row("a", "Test")), row("Result", "Batch 12X"))
    rows = F.when(F.col("p_size") % 3 != 0, rows).otherwise(F.slice(rows, 1, 2))
    return part(spark, d).select("p_partkey", records.header_row(rows).cast("int").alias("place"))


@query(
    "WITH d AS (SELECT p_partkey AS id, unnest(string_split(p_name || ' ' || lower(p_type), ' ')) AS term FROM part), t AS (SELECT id, term, count(*) AS tf FROM d WHERE term <> 'widget' GROUP BY 1, 2), f AS (SELECT term FROM t GROUP BY 1 ORDER BY sum(tf) DESC, term LIMIT 4), u AS (SELECT t.* FROM t JOIN f USING (term)), n AS (SELECT count(*) AS n FROM part), i AS (SELECT term, ln((1.0 + n) / (1.0 + count(*))) + 1 AS idf FROM u, n GROUP BY term, n), "
    "w AS (SELECT id, term, tf * idf AS w FROM u JOIN i USING (term)), q AS (SELECT term, idf AS qw FROM i WHERE term IN ('cold', 'small', 'economy', 'promo', 'standard')), qn AS (SELECT sqrt(sum(qw * qw)) AS qn FROM q), nn AS (SELECT id, sqrt(sum(w * w)) AS norm FROM w GROUP BY 1) SELECT w.id, round(sum(w * qw) / (norm * qn), 6) AS score FROM w JOIN q USING (term) JOIN nn USING (id), qn GROUP BY w.id, norm, qn"
)
def limited_vocabulary(spark, d):
    x = part(spark, d).select("p_partkey", say("$p_name", " ", "$p_type").alias("t"))
    return retrieval.tfidf_scores(x, "cold small economy promo standard", "p_partkey", "t", 4, ("widget",)).withColumn("score", F.round("score", 6))
