"""Queries of laboratory dossiers: tables, look-ups and run checks. Tests are parts, batches suppliers, results line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.operators import lab, lab_tables, usage
from tabloom.plans.catalogue import ORACLE_SQL, QUERIES, query, read
from tabloom.plans.texts import say
from tabloom.sources import cases, records


def tests(spark, d):
    k = F.col("p_partkey")
    return read(spark, d, "part").select(
        k.alias("test_id"), say("$p_name", F.when(k % 10 == 0, " impurity").otherwise(""), " ", k).alias("test"), F.when(k % 4 != 0, say("M-", k)).alias("method"), F.when(k % 6 != 0, say("NMT ", "$p_size")).alias("criterion"), F.col("p_size").alias("test_order"),
    )


TESTS = "(SELECT p_partkey AS test_id, p_name || CASE WHEN p_partkey % 10 = 0 THEN ' impurity' ELSE '' END || ' ' || p_partkey AS test, CASE WHEN p_partkey % 4 <> 0 THEN 'M-' || p_partkey END AS method, CASE WHEN p_partkey % 6 <> 0 THEN 'NMT ' || p_size END AS criterion, p_size AS test_order FROM part) t"


def results(spark, d):
    li = read(spark, d, "lineitem")
    return li.select(
        F.col("l_partkey").alias("test_id"), say("B", F.col("l_suppkey") % 4).alias("batch"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("result_id"), F.when(F.col("l_linestatus") == "F", "v").alias("verified_by"),
        say(F.col("l_quantity").cast("int"), " mg").alias("value_text"), F.col("l_quantity").alias("number"), F.when(F.col("l_returnflag") == "A", "25C").alias("condition"), F.when(F.col("l_linenumber") > 5, F.col("l_linenumber")).alias("months"),
    )


RESULTS = "(SELECT l_partkey AS test_id, 'B' || (l_suppkey % 4) AS batch, l_orderkey * 10 + l_linenumber AS result_id, l_linestatus = 'F' AS verified, CAST(l_quantity AS INTEGER) || ' mg' AS value_text, l_quantity AS number, CASE WHEN l_returnflag = 'A' THEN '25C' END AS condition, CASE WHEN l_linenumber > 5 THEN l_linenumber END AS months FROM lineitem) r"


@query(f"SELECT test_order, test, method, criterion, concat_ws(', ', CASE WHEN method IS NULL THEN 'no method identifier' END, CASE WHEN criterion IS NULL THEN 'no acceptance criterion' END) AS missing, row_number() OVER (ORDER BY test_order, test) AS place FROM {TESTS}")
def specification_table(spark, d):
    return usage.numbered(lab.render("spec_table", tests(spark, d)))


PICKED = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY test_id, batch ORDER BY NOT verified, result_id) AS k, count(*) OVER (PARTITION BY test_id, batch) AS n FROM {RESULTS}) WHERE k = 1)"


@query(f"SELECT test, criterion, " + ", ".join(f"max(CASE WHEN batch = 'B{b}' THEN CASE WHEN verified THEN value_text ELSE '[DATA NEEDED]' END END) AS B{b}" for b in range(4)) + f", count(*) FILTER (n > 1) AS notes FROM {TESTS} LEFT JOIN {PICKED} p USING (test_id) GROUP BY test_id, test, criterion")
def batch_analyses(spark, d):
    return lab.render("batch_analyses", results(spark, d), tests(spark, d), ["B0", "B1", "B2", "B3"])


def components(spark, d):
    k = F.col("p_partkey")
    return read(spark, d, "part").select(
        k.alias("id"), F.col("p_name").alias("component"), F.col("p_type").alias("function"), F.col("p_size").alias("quantity"), F.lit("mg").alias("unit"), (F.col("p_size") / 2).cast("decimal(9,2)").alias("percent"), (F.col("p_size") * 10).alias("per_batch"),
        F.lit("USP").alias("standard"), F.when(k % 3 != 0, "u").alias("verified_by"), F.col("p_size").alias("sort_order"), F.col("p_brand").alias("deliverable"),
    )


HELD = "CASE WHEN p_partkey % 3 = 0 THEN '[DATA NEEDED]' ELSE {} END"


@query(f"SELECT p_name AS component, p_type AS function, {HELD.format("p_size || ' mg'")} AS quantity, {HELD.format('CAST(CAST(p_size / 2 AS DECIMAL(9,2)) AS VARCHAR)')} AS percent, {HELD.format('CAST(p_size * 10 AS VARCHAR)')} AS per_batch, {HELD.format("'USP'")} AS standard, row_number() OVER (ORDER BY p_size, p_name, p_partkey) AS place FROM part")
def batch_formula_table(spark, d):
    return usage.numbered(lab.render("batch_formula", components(spark, d)))


@query(f"SELECT p_name AS component, p_type AS function, {HELD.format("p_size || ' mg'")} AS quantity, {HELD.format('CAST(CAST(p_size / 2 AS DECIMAL(9,2)) AS VARCHAR)')} AS percent FROM part")
def composition_table(spark, d):
    return lab.render("composition_table", components(spark, d))


@query("SELECT 'FORMULA_TOTAL' AS code, 'blocker' AS severity, p_brand || ' ' || CAST(sum(CAST(p_size / 2 AS DECIMAL(9,2))) AS DECIMAL(18,2)) AS message FROM part GROUP BY p_brand HAVING abs(sum(CAST(p_size / 2 AS DECIMAL(9,2))) - 100) > 0.5")
def check_formula_totals(spark, d):
    return lab.formula_findings(components(spark, d), "deliverable").select("code", "severity", "message")


@query("SELECT s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'Street ' || s_suppkey END AS address, CASE WHEN s_suppkey % 3 <> 0 THEN 'ID' || s_suppkey END AS identifier, 'makes, tests' AS activities, concat_ws(', ', CASE WHEN s_suppkey % 2 <> 0 THEN 'no address' END, CASE WHEN s_suppkey % 3 = 0 THEN 'no identifier' END) AS missing FROM supplier WHERE s_suppkey % 7 <> 0")
def site_table(spark, d):
    k = F.col("s_suppkey")
    s = read(spark, d, "supplier").select(F.col("s_name").alias("name"), F.when(k % 2 == 0, say("Street ", k)).alias("address"), F.when(k % 3 != 0, say("ID", k)).alias("identifier"), F.array(F.lit("makes"), F.lit("tests")).alias("activities"), F.when(k % 7 == 0, F.current_date()).alias("deleted_at"))
    return lab.render("site_list", s)


@query(f"SELECT test, criterion, CASE WHEN a IS NULL THEN '[DATA NEEDED]' WHEN a = b THEN a ELSE a || ' - ' || b END AS observed FROM {TESTS} LEFT JOIN (SELECT test_id AS k, CAST(min(number) AS INTEGER) || ' mg' AS a, CAST(max(number) AS INTEGER) || ' mg' AS b FROM {RESULTS} GROUP BY 1) o ON k = test_id WHERE test LIKE '%impurity%'")
def impurity_table(spark, d):
    return lab.render("impurity_table", results(spark, d), tests(spark, d))


@query(f"SELECT CASE WHEN condition IS NULL AND months IS NULL THEN 'release' ELSE 'stability' END AS kind, count(*) AS n, count(DISTINCT batch) AS names FROM {RESULTS} WHERE NOT verified GROUP BY 1")
def unverified_data(spark, d):
    r = results(spark, d).withColumn("kind", lab.result_kind(F.col("condition"), F.col("months")))
    return lab.unverified(r, "kind", "batch", "verified_by").select("kind", "n", F.size("names").cast("long").alias("names"))


@query(f"SELECT test, count(*) AS n, min(result_id) AS first_id FROM {RESULTS} JOIN {TESTS} USING (test_id) WHERE verified GROUP BY 1")
def verified_data_by_test(spark, d):
    v = lab.verified_by_test(results(spark, d), tests(spark, d), "test_id", "test", "verified_by", ["value_text", "condition"], "result_id")
    return v.select("test", F.size("results").cast("long").alias("n"), F.get("results", F.lit(0))["result_id"].alias("first_id"))


@query("SELECT r.n_nationkey, (SELECT min_by(t.n_nationkey, [CASE WHEN f = k THEN 0 ELSE 1 END, -least(length(f), length(k)), t.n_nationkey]) FROM (SELECT n_nationkey, n_regionkey, 'test' || n_nationkey AS f FROM nation) t WHERE t.n_regionkey = r.n_regionkey AND (starts_with(f, k) OR starts_with(k, f))) AS test_id FROM (SELECT *, 'test' || (n_nationkey % 3) || CASE WHEN n_nationkey % 2 = 0 THEN '0' ELSE '' END AS k FROM nation) r")
def test_lookup(spark, d):
    n = read(spark, d, "nation")
    k = F.col("n_nationkey")
    rows = n.select("n_nationkey", "n_regionkey", say("Test-", k % 3, F.when(k % 2 == 0, "0").otherwise("")).alias("name"))
    return lab.test_for(rows, n.select("n_regionkey", say("TEST ", k).alias("name"), k.alias("id")), "n_regionkey", "name", "id").select("n_nationkey", "test_id")


@query("SELECT p_partkey FROM part WHERE p_size % 3 = 0")
def unit_drift(spark, d):
    u = F.when(F.col("p_size") % 3 == 0, "mg/L").when(F.col("p_size") % 3 == 1, " µG / mL").otherwise("")
    return lab.unit_drift(read(spark, d, "part").select("p_partkey", u.alias("u"), F.lit("μg/ml").alias("t")), "u", "t").select("p_partkey")


@query("SELECT DISTINCT 'M-' || p_size AS method FROM part WHERE p_size % 4 = 0")
def untraceable_methods(spark, d):
    p = read(spark, d, "part").select(say("M-", "$p_size").alias("method"), F.when(F.col("p_size") % 4 != 0, say("use m-", "$p_size", ", then stop")).otherwise("none").alias("text"))
    return lab.sop_untraceable(p.select("method"), p.select("text"), "method", "text")


#: Checks of a laboratory dossier: the query that finds, the code and severity of its findings, and which of its rows are findings.
DOSSIER_CHECKS = (
    ("limit_verdict", "OUT_OF_SPECIFICATION", "blocker", "outcome = 'FAIL'"), ("unverified_data", "UNVERIFIED", "blocker", "true"), ("spec_conflicts", "SPEC_CONFLICT", "blocker", "true"), ("untraceable_methods", "METHOD", "blocker", "true"),
    ("check_formula_totals", "FORMULA_TOTAL", "blocker", "true"), ("declared_gaps", "DATA_NEEDED", "blocker", "true"), ("unknown_tables", "UNKNOWN_TABLE", "blocker", "true"), ("stability_holes", "STABILITY_INCOMPLETE", "warning", "true"),
    ("trend_extrapolation", "TREND", "warning", "true"), ("unit_drift", "UNIT", "warning", "true"), ("name_variants", "NAME", "warning", "true"), ("compendial_claims", "COMPENDIAL", "info", "true"),
    ("undefined_abbreviations", "ABBREVIATION", "info", "not expanded"),
)


@query(" UNION ALL ".join(f"SELECT '{code}' AS code, '{severity}' AS severity, count(*) AS n FROM ({ORACLE_SQL[name]}) WHERE {bad} HAVING count(*) > 0" for name, code, severity, bad in DOSSIER_CHECKS))
def laboratory_quality_run(spark, d):
    """All checks of a dossier in one list of findings, counted by code."""
    parts = [lab.finding(QUERIES[name](spark, d).where(bad), code, severity, F.lit(name)) for name, code, severity, bad in DOSSIER_CHECKS]
    return lab.findings(*parts).groupBy("code", "severity").agg(F.count("*").alias("n"))


@query(f"SELECT CASE WHEN condition IS NULL AND months IS NULL THEN 'release' ELSE 'stability' END AS kind, count(*) AS n FROM {RESULTS} GROUP BY 1")
def result_kinds(spark, d):
    return results(spark, d).groupBy(lab.result_kind(F.col("condition"), F.col("months")).alias("kind")).agg(F.count("*").alias("n"))


# Tables as documents hold them


@query("SELECT p_partkey, ['test', 'criterion', 'method', 'unit', 'batch', 'timepoint', 'result', NULL][p_size % 8 + 1] AS role, CASE WHEN p_size % 8 = 4 THEN 'A-' || lpad(p_partkey::VARCHAR, 4, '0') END AS batch FROM part")
def table_headers(spark, d):
    names = ("Test parameter", "Acceptance criteria", "Analytical procedure", " Units ", None, "Time point", "Value found", "Remarks")
    h = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("p_size") % 8 + 1)
    h = F.coalesce(h, say("Batch No. A-", F.lpad(F.col("p_partkey").cast("string"), 4, "0")))
    return read(spark, d, "part").select("p_partkey", records.header_role(h).alias("role"), records.batch_of(h).alias("batch"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 <> 0 THEN '14.' || p_size || '.1' END AS table_id, CASE WHEN p_size % 3 <> 0 THEN p_name ELSE 'About ' || p_name END AS title FROM part")
def table_identities(spark, d):
    c = F.when(F.col("p_size") % 3 == 0, say(" About ", "$p_name")).otherwise(say("Table 14.", "$p_size", ".1: ", "$p_name"))
    return read(spark, d, "part").select("p_partkey", records.table_identity(c).alias("i")).select("p_partkey", "i.table_id", "i.title")


@query("SELECT p_partkey, 2::BIGINT AS n, p_name || '|' AS first, 'x|' || p_brand AS last FROM part")
def table_rows(spark, d):
    row = lambda *c: F.array(*c)
    rows = F.array(row(say(" ", "$p_name", " "), F.lit(None).cast("string")), row(F.lit(" "), F.lit("")), row(F.lit("x"), F.col("p_brand")))
    t = records.clean_table(rows)
    return read(spark, d, "part").select("p_partkey", t.alias("t")).select("p_partkey", F.size("t").cast("long").alias("n"), F.array_join(F.get("t", F.lit(0)), "|").alias("first"), F.array_join(F.get("t", F.lit(1)), "|").alias("last"))


@query("SELECT p_partkey, p_name AS test, 'NMT ' || p_size AS criterion, CAST(p_size AS VARCHAR) AS result FROM part")
def laboratory_tables(spark, d):
    rows = read(spark, d, "part").select("p_partkey", F.array(F.lit("Test"), F.lit("Limit"), F.lit("Result"), F.lit("Remark")).alias("headers"), F.array(F.col("p_name"), say("NMT ", "$p_size"), F.col("p_size").cast("string"), F.lit("none")).alias("cells"))
    m = records.laboratory_table(rows, "headers", "cells")
    return m.select("p_partkey", *[F.element_at("by_role", F.lit(r)).alias(r) for r in ("test", "criterion", "result")])


LONG_RESULTS = """
WITH s AS (SELECT *, s_nationkey AS n, s_nationkey % 3 AS kind, s_acctbal::VARCHAR AS v FROM supplier),
filled AS (SELECT *, CASE WHEN s_suppkey % 4 = 0 THEN s_suppkey END AS own FROM s WHERE kind = 2),
down AS (SELECT *, max(own) OVER (PARTITION BY n ORDER BY s_suppkey) AS head FROM filled)
SELECT 'T' || n AS table_id, s_suppkey + 10 AS row_no, c::INTEGER AS col_no, 'A-' || n || (c - 1) AS batch, s_name AS test, 'NMT 5' AS criterion, NULL AS condition, NULL::DOUBLE AS month,
  CASE c WHEN 2 THEN v ELSE '< 5' END AS value FROM s, range(2, 4) r(c) WHERE kind = 0 AND (c = 2 OR s_suppkey % 2 = 0)
UNION ALL SELECT 'T' || n, s_suppkey + 10, c::INTEGER, 'B-' || n || ((c + 1) // 2), s_name, NULL, '30C/65RH', CASE c % 2 WHEN 1 THEN 0.0 ELSE 3.0 END, v || '/' || c FROM s, range(1, 5) r(c) WHERE kind = 1 AND (c < 4 OR s_suppkey % 3 <> 0)
UNION ALL SELECT 'T' || n, s_suppkey + 10, 4, 'C-' || head, s_name, NULL, '40C/75RH', (s_suppkey % 12)::DOUBLE, v FROM down WHERE head IS NOT NULL
"""


@query(LONG_RESULTS)
def laboratory_results(spark, d):
    """Three layouts over all suppliers, a table per nation: batches as columns; batches over months, ragged; one value a row
    with batch and condition written once and blank below."""
    s = read(spark, d, "supplier").withColumn("kind", F.col("s_nationkey") % 3).withColumn("v", F.col("s_acctbal").cast("string"))
    n, k = F.col("s_nationkey"), F.col("kind")
    texts = lambda *c: F.array(*[F.lit(x) if isinstance(x, str) else x for x in c])
    title = F.when(k == 0, "Release").when(k == 1, "Stability at 30 °C / 65 % RH").otherwise("All results")
    tables = s.select(n, "kind").distinct()
    spans = tables.where("kind = 1").select(n, k, F.lit(0).alias("row_no"), texts("", say("Batch B-", n, "1"), "", say("Lot no. B-", n, "2"), "").alias("cells"))
    head = F.when(k == 0, texts("Test", "Acceptance criterion", say("Batch A-", n, "1"), say("Batch A-", n, "2"), "Remark")).when(k == 1, texts("Test", "Initial", "3 months", "Initial", "3 months")).otherwise(texts("Batch No.", "Storage condition", "Month", "Parameter", "Result"))
    heads = tables.select(n, k, F.lit(1).alias("row_no"), head.alias("cells"))
    row = F.col("s_suppkey")
    filled = lambda c: F.when(row % 4 == 0, c).otherwise("")
    wide = F.array(say(" ", "$s_name"), F.lit("NMT  5"), F.col("v"), F.when(row % 2 == 0, "<  5").otherwise(" "), F.lit("ok"))
    months = F.array(F.col("s_name"), *[say("$v", "/", F.lit(i)) for i in (1, 2, 3)])
    months = F.when(row % 3 == 0, months).otherwise(F.concat(months, F.array(say("$v", "/", F.lit(4)))))
    down = F.array(filled(say("C-", row)), filled(F.lit("40 °C / 75 % RH")), (row % 12).cast("string"), F.col("s_name"), F.col("v"))
    body = s.select(n, k, (row + 10).alias("row_no"), F.when(k == 0, wide).when(k == 1, months).otherwise(down).alias("cells"))
    every = spans.unionByName(heads).unionByName(body).select(say("T", n).alias("table_id"), title.alias("title"), F.col("row_no").cast("long"), "cells")
    return lab_tables.laboratory_results(every).select("table_id", "row_no", "col_no", "batch", "test", "criterion", "condition", "month", "value")


@query("SELECT s_suppkey::VARCHAR AS s_suppkey, s_name, CASE WHEN s_suppkey % 2 = 0 THEN 'a, \"b\"' ELSE '' END AS note, 'csv' AS _sheet FROM supplier")
def csv_records(spark, d):
    """The table written as csv with a header line, read back as records."""
    from tabloom.operators.joins import shared_path

    path = shared_path(spark, "csv")
    s = read(spark, d, "supplier").select(F.col("s_suppkey").cast("string"), "s_name", F.when(F.col("s_suppkey") % 2 == 0, ' a, "b" ').otherwise("").alias("note"))
    s.coalesce(1).write.option("header", True).option("escape", '"').csv(path)
    return records.read_source(spark, path, "csv").drop("_row_index")


@query(
    "SELECT s_nationkey, 'Stock' AS sheet, s_suppkey, s_name, (DATE '2023-12-25' + CAST(s_suppkey AS INTEGER))::VARCHAR AS since, replace(strftime(TIMESTAMP '2024-01-01 00:30:00' + to_minutes(s_suppkey * 61), '%Y-%m-%d %H:%M'), ' 00:00', '') AS seen, "
    "(s_suppkey * 2)::VARCHAR AS pieces, CASE WHEN s_suppkey % 2 = 0 THEN 'True' ELSE 'False' END AS open FROM supplier UNION ALL SELECT n_nationkey, 'Notes', NULL, n_name, NULL, NULL, NULL, NULL FROM nation"
)
def workbook_cells(spark, d):
    """A workbook per nation, written on the executors and read again: its sheets are in parts of other names, its cells typed."""
    from datetime import datetime, timedelta

    import pandas as pd

    from tabloom.sources import workbooks

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        key, name = int(pdf["n_nationkey"][0]), pdf["n_name"][0]
        stock = [["Key", "Name", "Since", "Seen", "Pieces", "Open"]]
        for k, who in zip(pdf["s_suppkey"], pdf["s_name"], strict=True):
            if not pd.isna(k):
                k = int(k)
                stock.append([k, who, datetime(2023, 12, 25) + timedelta(days=k), datetime(2024, 1, 1, 0, 30) + timedelta(minutes=61 * k), float(2 * k), k % 2 == 0])
        return pd.DataFrame({"content": [workbooks.package([("Notes", [[key, name]]), ("Stock", stock)])]})

    both = read(spark, d, "nation").join(read(spark, d, "supplier"), F.col("s_nationkey") == F.col("n_nationkey"), "left").select("n_nationkey", "n_name", "s_suppkey", "s_name")
    packages = both.groupBy("n_nationkey").applyInPandas(write, "content binary")
    rows = records.sheet_rows(packages).where("at >= 0")
    c = lambda i: F.get("cells", F.lit(i))
    stock = rows.where("sheet = 'Stock' and at > 0").select(c(0).cast("long").alias("s_suppkey"), "sheet", c(1).alias("s_name"), c(2).alias("since"), c(3).alias("seen"), c(4).alias("pieces"), c(5).alias("open"))
    stock = read(spark, d, "supplier").select("s_suppkey", "s_nationkey").join(stock, "s_suppkey")
    none = F.lit(None)
    notes = rows.where("sheet = 'Notes'").select(c(0).cast("long").alias("s_nationkey"), "sheet", none.cast("long").alias("s_suppkey"), c(1).alias("s_name"), *[none.cast("string").alias(x) for x in ("since", "seen", "pieces", "open")])
    return stock.select(notes.columns).unionByName(notes)


@query(
    "SELECT s_nationkey AS nation, r // 30 + 1 AS page, (r % 30 + 1)::INTEGER AS row_no, s_suppkey::VARCHAR AS key, s_name AS name, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE s_acctbal::VARCHAR END AS balance "
    "FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS r FROM supplier)"
)
def pdf_tables(spark, d):
    """A PDF of each nation's suppliers, thirty a page under a heading, written on the executors and read as tables."""
    import pandas as pd

    from tabloom.sources import layouts

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, pages = pdf.sort_values("s_suppkey").values.tolist(), []
        for start in range(0, len(rows), 30):
            page = [(40.0, 780.0, f"Suppliers of nation {rows[0][0]}"), (40.0, 740.0, "Key"), (140.0, 740.0, "Name"), (340.0, 740.0, "Balance")]
            for i, (_, key, name, balance) in enumerate(rows[start : start + 30]):
                y = 726.0 - 14 * i
                page += [(40.0, y, str(key)), (140.0, y, name)] + ([(340.0, y, balance)] if key % 3 else [])
            pages.append(page)
        return pd.DataFrame({"path": [str(rows[0][0])], "content": [layouts.plain_pdf(pages)]})

    s = read(spark, d, "supplier").select("s_nationkey", "s_suppkey", "s_name", F.col("s_acctbal").cast("string").alias("balance"))
    found = layouts.document_tables(s.groupBy("s_nationkey").applyInPandas(write, "path string, content binary")).where("row_no > 0")
    cell = lambda i: F.get("cells", F.lit(i))
    return found.select(F.col("path").cast("long").alias("nation"), F.col("page").cast("long").alias("page"), "row_no", cell(0).alias("key"), cell(1).alias("name"), cell(2).alias("balance"))


@query("SELECT n_name AS pt, r_name AS soc, 'v1' AS version FROM nation JOIN region ON r_regionkey = n_regionkey")
def dictionary_terms(spark, d):
    from tabloom.operators.joins import shared_path

    path = shared_path(spark, "dictionary")
    r = read(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    n = read(spark, d, "nation").join(r, "n_regionkey").select(F.lower("n_name").alias(" LLT"), say(" ", "$n_name").alias("PT "), F.col("r_name").alias("Soc"))
    n.unionByName(n.limit(3)).coalesce(1).write.option("header", True).csv(path)
    return records.read_dictionary(spark, path, "v1").select("pt", "soc", "version")


@query("SELECT n_nationkey::VARCHAR AS id, n_name AS name FROM nation")
def xml_case_reports(spark, d):
    from tabloom.operators.joins import shared_path

    path = shared_path(spark, "cases")
    n = read(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    n.write.format("xml").option("rowTag", "safetyreport").option("rootTag", "ichicsr").save(path)
    return records.read_source(spark, path, "xml").select("id", "name")


CASES_SQL = """
WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS no FROM orders),
e AS (SELECT o_custkey, string_agg(o_orderpriority || '@' || o_orderdate::DATE || ':' || CASE o_orderstatus WHEN 'F' THEN 'fatal' ELSE 'unknown' END, '|' ORDER BY o_orderkey) AS events, string_agg('Drug ' || o_orderkey % 7 || '/' || CASE WHEN o_orderkey % 2 = 0 THEN 'suspect' ELSE 'concomitant' END, '|' ORDER BY o_orderkey) AS drugs FROM o GROUP BY 1)
SELECT 'W-' || c_custkey AS worldwide_case_id, CASE WHEN c_custkey % 2 = 0 THEN 'clinical_trial' ELSE 'spontaneous' END AS report_source, '1995-03-01' AS received, CASE WHEN c_custkey % 3 = 0 THEN true END AS is_serious,
  round(c_custkey % 90 / 12.0, 4)::DOUBLE AS patient_age, coalesce(events, '') AS events, coalesce(drugs, '') AS drugs, c_mktsegment AS kept
FROM customer LEFT JOIN e ON o_custkey = c_custkey
"""


#: Cases that are written to a file: a file of reports is read as a whole.
FILE_CASES = 1_000


@query(CASES_SQL)
def nested_cases(spark, d):
    """A case for each customer, with an event and a drug for each order: half written as elements, half as attributes in a namespace."""
    from tabloom.operators.joins import shared_path

    o, k = read(spark, d, "orders"), F.col("o_orderkey")
    day = F.date_format("o_orderdate", "yyyyMMdd")
    reaction = F.struct(F.col("o_orderpriority").alias("primarysourcereaction"), day.alias("reactionstartdate"), F.when(F.col("o_orderstatus") == "F", "5").otherwise("6").alias("reactionoutcome"))
    drug = F.struct(say("Drug ", k % 7).alias("medicinalproduct"), F.when(k % 2 == 0, "1").otherwise("2").alias("drugcharacterization"))
    per = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct(k, reaction.alias("r"), drug.alias("d")))).alias("all"))
    c = read(spark, d, "customer").join(per, F.col("o_custkey") == F.col("c_custkey"), "left")
    ident = F.col("c_custkey")
    part = lambda f: F.transform(F.coalesce("all", F.array()), lambda x: x[f])
    patient = F.struct((ident % 90).cast("string").alias("patientonsetage"), F.lit("802").alias("patientonsetageunit"), part("r").alias("reaction"), part("d").alias("drug"))
    top = [say("W-", ident).alias("safetyreportid"), F.when(ident % 2 == 0, "2").otherwise("1").alias("reporttype"), F.lit("199503").alias("receivedate"), F.when(ident % 3 == 0, "1").alias("seriousnessdeath"), F.col("c_mktsegment").alias("segment")]
    path = shared_path(spark, "reports")
    c.where(ident % 2 == 0).select(*top, patient.alias("patient")).write.format("xml").option("maxRecordsPerFile", FILE_CASES).option("rowTag", "safetyreport").option("rootTag", "ichicsr").save(f"{path}/old")
    # The newer form: each leaf is an empty element with its value in an attribute.
    as_attribute = lambda x: F.struct(x.alias("_value"))
    leaf = lambda x, names: F.struct(*[as_attribute(x[n]).alias(n) for n in names])
    newer = F.struct(
        as_attribute((ident % 90).cast("string")).alias("patientonsetage"), as_attribute(F.lit("802")).alias("patientonsetageunit"),
        F.transform(part("r"), lambda x: leaf(x, ("primarysourcereaction", "reactionstartdate", "reactionoutcome"))).alias("reaction"), F.transform(part("d"), lambda x: leaf(x, ("medicinalproduct", "drugcharacterization"))).alias("drug"),
    )
    c.where(ident % 2 == 1).select(*top, newer.alias("patient")).write.format("xml").option("maxRecordsPerFile", FILE_CASES).option("rowTag", "safetyreport").option("rootTag", 'MCCI xmlns="urn:v3"').save(f"{path}/new")
    found = cases.read_xml_cases(spark, f"{path}/*/part-*")
    listed = lambda c, f: F.array_join(F.transform(c, f), "|")
    return found.select(
        "worldwide_case_id", "report_source", F.col("initial_receipt_date").cast("string").alias("received"), "is_serious", "patient_age",
        listed("events", lambda e: F.concat(e["verbatim_term"], F.lit("@"), e["onset_date"].cast("string"), F.lit(":"), e["outcome"])).alias("events"),
        listed("drugs", lambda x: F.concat(x["drug_name"], F.lit("/"), x["role"])).alias("drugs"), F.element_at("unmapped", F.lit("segment")).alias("kept"),
    )


def listing(spark, d):
    """A listing of all orders, one row each; the case is the customer, and every fiftieth row names none."""
    o, k = read(spark, d, "orders"), F.col("o_orderkey")
    return o.select(
        k.alias("_row_index"), F.when(k % 50 != 0, say("W-", "$o_custkey")).otherwise(" ").alias("Case ID"), F.date_format("o_orderdate", "dd/MM/yyyy").alias("Onset"), F.col("o_orderpriority").alias("Term"),
        say("Drug ", k % 7).alias("Drug"), F.when(k % 3 == 0, "Death; Life threatening").otherwise("").alias("Criteria"), (k % 80).cast("string").alias("Age"),
    )


LISTING = {"Case ID": "worldwide_case_id", "Onset": "onset_date", "Term": "verbatim_term", "Drug": "drug_name", "Criteria": "seriousness_criteria", "Age": "patient_age"}


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS no FROM orders WHERE o_orderkey % 50 <> 0),
g AS (SELECT o_custkey, 'Drug ' || o_orderkey % 7 AS drug, min(o_orderkey) AS k FROM r GROUP BY 1, 2), d AS (SELECT o_custkey, string_agg(drug, '|' ORDER BY k) AS drugs FROM g GROUP BY 1)
SELECT 'W-' || o_custkey AS worldwide_case_id, CASE WHEN any_value(o_orderkey) FILTER (no = 1) % 3 = 0 THEN true END AS is_serious, CASE WHEN any_value(o_orderkey) FILTER (no = 1) % 3 = 0 THEN 'death,life_threatening' ELSE '' END AS criteria,
  (any_value(o_orderkey) FILTER (no = 1) % 80)::DOUBLE AS patient_age, string_agg(o_orderpriority || '@' || o_orderdate::DATE, '|' ORDER BY o_orderkey) AS events, any_value(drugs) AS drugs
FROM r JOIN d USING (o_custkey) GROUP BY o_custkey
""")
def listed_cases(spark, d):
    found, _ = cases.listing_cases(listing(spark, d), LISTING, order="day_first")
    return found.select("worldwide_case_id", "is_serious", F.array_join("seriousness_criteria", ",").alias("criteria"), "patient_age", F.array_join(F.transform("events", lambda e: F.concat(e["verbatim_term"], F.lit("@"), e["onset_date"].cast("string"))), "|").alias("events"), F.array_join(F.transform("drugs", lambda x: x["drug_name"]), "|").alias("drugs"))


@query("SELECT o_orderkey AS no, CASE WHEN o_orderkey % 50 = 0 THEN 'no case identifier' ELSE 'onset_date ' || strftime(o_orderdate, '%d/%m/%Y') || ' reads two ways and no date order is given' END AS reason FROM orders WHERE o_orderkey % 50 = 0 OR day(o_orderdate) <= 12")
def skipped_listing_rows(spark, d):
    return cases.listing_cases(listing(spark, d), LISTING)[1]


@query("SELECT i::INTEGER AS part, CASE i WHEN 0 THEN 'First of the text.' ELSE 'Second part. Third part.' END AS text, count(*) AS n FROM nation, range(2) r(i) GROUP BY 1, 2")
def text_file_chunks(spark, d):
    from tabloom.operators.joins import shared_path

    path = shared_path(spark, "texts")
    t = read(spark, d, "nation").select(F.lit("First of the text.\n\nSecond part. Third part.").alias("value"), F.col("n_nationkey").alias("k"))
    t.write.partitionBy("k").text(path)
    return records.read_source(spark, f"{path}/k=*", "txt").groupBy("part", "text").agg(F.count("*").alias("n"))
