from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tabloom.operators import clusters, conditions, formulas, lab, lifecycle, metrics, privacy, resolution, safety, text_checks, usage
from tabloom.streaming.operators import admit


@pytest.mark.parametrize(
    ("rule", "record", "verdict"),
    [
        ("kind == 'Full time'", {"kind": "Full Time"}, "KEEP"), ("region == 'EU'", {"region": "  eu  "}, "KEEP"), ("region == 'EU'", {"region": "EUR"}, "REMOVE"), ("hours >= 38", {"hours": "38"}, "KEEP"), ("pay > 50000", {"pay": "95,000"}, "KEEP"),
        ("pay > 50000", {"pay": None}, "UNDECIDED"), ("pay > 50000 OR region = 'EU'", {"pay": None, "region": "EU"}, "UNDECIDED"), ("line2 is blank", {"line2": ""}, "KEEP"), ("line2 is not blank", {"line2": ""}, "REMOVE"), ("region in ['eu', 'uk']", {"region": "UK"}, "KEEP"), ("gone == 1", {}, "UNDECIDED"),
    ],
)
def test_conditions(spark, rule, record, verdict):
    row = spark.range(1).select(*[F.lit(v).cast("string").alias(k) for k, v in record.items()] or [F.lit(1).alias("_")])
    assert row.select(conditions.verdict(rule, list(record)).alias("v")).first()["v"] == verdict


def test_condition_language():
    assert conditions.inputs("a = 0 AND b is blank") == ["a", "b"]
    assert conditions.unparse(conditions.unparse("a = 0 AND not b > 1")) == conditions.unparse("a = 0 AND not b > 1")
    with pytest.raises(conditions.ConditionError):
        conditions.parse("__import__('os')")
    assert ("unknown_field", "z") in conditions.typecheck("z > 1", {}) and conditions.typecheck("a > 1", {"a": "date"})[0][0] == "incompatible_comparison"
    assert "is one of" in conditions.plain_english("a in ['x']") and "a person decides" in conditions.approval_sentence("a == 1")


def test_formulas(spark):
    df = spark.createDataFrame([("1,000", "4", "x")], "a string, b string, c string")
    f = lambda e: df.select(formulas.formula(e, ["a", "b", "c"]).alias("f")).first()["f"]
    assert f("a / b + max(a, 2000)")["value"] == 2250 and f("round(2.5)")["value"] == 2 and f("7 // 2 + 7 % 4")["value"] == 6
    assert not f("a / (b - 4)")["ok"] and "zero" in f("a / (b - 4)")["error"] and "c" in f("a + c")["error"]
    with pytest.raises(formulas.FormulaError):
        formulas.parse("open('x')")


def test_windows(spark):
    since, until, days = usage.window("7d", datetime(2026, 3, 10, 17, 30))
    assert (since, days) == (datetime(2026, 3, 4), 7)
    with pytest.raises(ValueError):
        usage.window("5d", until)
    with pytest.raises(ValueError):
        usage.tenant_scope(spark.range(1), " ")
    calls = spark.createDataFrame([(datetime(2026, 3, 4, 1), None), (datetime(2026, 3, 6, 1), 5)], "ts timestamp_ntz, cost long")
    assert usage.usage_summary(calls.where("cost is null"), {"cost": "cost"}, "cost").first()["cost"] is None
    t = usage.trend(calls, since, until).collect()
    assert len(t) == 7 and sum(r["value"] for r in t) == 2


def test_safety(spark):
    s = safety.Scope("o", "p", date(2026, 1, 1), date(2026, 6, 30), date(2026, 7, 15), date(2016, 1, 1))
    rows = [("INT-1", date(2026, 3, 4), None, True), ("INT-2", date(2026, 4, 11), None, False), ("OLD-1", date(2022, 6, 1), None, True), ("LATE-1", date(2026, 8, 1), None, True), ("NO", None, None, False)]
    cases = spark.createDataFrame([("o", "p", *r) for r in rows], "org_id string, product string, case_id string, initial_receipt_date date, latest_receipt_date date, is_serious boolean")
    p = safety.preview(cases, s).first().asDict()
    assert p == {"stored": 5, "interval": 2, "cumulative": 3, "undated": 1, "after_lock": 1, "interval_serious": 1, "background": 0}
    labels = {r["case_id"]: r["w"] for r in cases.select("case_id", safety.window_label(s).alias("w")).collect()}
    assert labels == {"INT-1": "interval", "INT-2": "interval", "OLD-1": "cumulative", "LATE-1": "after_lock", "NO": "undated"}
    ev = [("INT-1", 1, "n", "Headache", "unlisted", "u", True), ("INT-1", 2, "n", "Nausea", "listed", None, None), ("INT-2", 3, "n", "Headache", "listed", "u", False), ("LATE-1", 4, "n", "Headache", "listed", "u", True)]
    events = spark.createDataFrame(ev, "case_id string, event_id int, soc string, pt string, expectedness string, confirmed_by string, event_serious boolean")
    x = {r["pt"]: r for r in safety.cross_tab(events, cases, {"interval": safety.interval(s)}).collect()}
    assert x["Headache"]["interval_serious_unlisted"] == 1 and x["Headache"]["interval_other_listed"] == 1 and x["Headache"]["interval_ids"] == [1, 3] and x["Nausea"]["interval_serious_unconfirmed"] == 1
    related = spark.range(1).select(safety.is_related(F.lit("Possible"), F.lit(None).cast("string")).alias("a"), safety.is_related(F.lit(None).cast("string"), F.lit(" ")).alias("b"), safety.is_related(F.lit("no"), F.lit("unlikely")).alias("c")).first()
    assert tuple(related) == (True, None, False)


def test_listing(spark):
    rows = [("GB-001", "GB", "Headache", 1), ("GB-001", None, "Nausea", 2), ("GB-002", "GB", "Rash", 3), ("", "GB", "Lost", 4)]
    df = spark.createDataFrame(rows, "case_id string, country string, term string, n int")
    out = safety.line_listing(df, "case_id", ["country"], "term", "n").collect()
    assert len(out) == 2 and sum(len(r["events"]) for r in out) == 3 and safety.skipped_rows(df, "case_id").count() == 1


def test_pairs(spark):
    c = "case_id string, worldwide_case_id string, local_ids array<string>, country string, sex string, age double, qualification string, receipt_date date, terms array<string>, onsets array<date>, drugs array<string>"
    d = date(2026, 1, 1)
    df = spark.createDataFrame([("a", "W1", [], "GB", "F", 34.0, "md", d, ["rash"], [d], ["x"]), ("b", "W1", [], "FR", "M", 70.0, None, None, [], [], []), ("c", None, [], "GB", "F", 34.5, "md", d, ["rash"], [], []), ("d", None, [], "GB", "F", 80.0, None, None, [], [], [])], c)
    pairs = {(r["a"], r["b"]): r["score"] for r in safety.duplicate_pairs(df).collect()}
    assert ("a", "c") in pairs and ("a", "d") not in pairs and ("a", "b") not in pairs


def test_metrics(spark):
    df = spark.createDataFrame([("a", float(v), i) for i, v in enumerate([1, 2, 3, 10])], "op string, ms double, n int")
    r = metrics.slo_report(df, "op", "ms", F.col("ms") < 0, [F.desc("n")]).first()
    assert (r["p50"], r["p95"], r["slowest"], r["errors"]) == (2.0, 10.0, 10.0, 0)
    m = metrics.guarded_rate(df.where("false"), "k", F.count("*"), F.count("*"), "none").first()
    assert m["value"] is None and m["unavailable_reason"] == "none"
    t = {r["column"]: r["observed_type"] for r in metrics.column_types(spark.createDataFrame([("1", "2026-01-01", "x", ""), ("2,000", "2026-02-01", "3", None)], "a string, b string, c string, d string"), list("abcd")).collect()}
    assert t == {"a": "number", "b": "date", "c": "text", "d": None}
    assert metrics.canary_positions(10) == [0, 3, 6] and metrics.canary_positions(2) == [0, 1]


def test_resolution(spark):
    U = resolution.Unit
    units = [U("total", "computed", "pay + bonus"), U("pay", "source", "Salary"), U("bonus", "source", "Bonus", "DEFAULT", "0"), U("keep", "conditional", "total > 100"), U("sign", "human")]
    df = spark.createDataFrame([("90", "20"), ("90", "n/a"), (None, "5")], "Salary string, Bonus string")
    out = resolution.resolve(df, units).collect()
    assert [r["keep"] for r in out] == ["KEEP", "REMOVE", None] and all(r["blocked"] for r in out)
    assert {x["unit"]: x["status"] for x in out[1]["lineage"]}["bonus"] == "defaulted"
    with pytest.raises(ValueError):
        resolution.order([U("a", "computed", "b"), U("b", "computed", "a")])
    b = resolution.apply_binding(spark.createDataFrame([("FT",), ("pt",)], "t string"), {"kind": "t"}, {"kind": {"FT": "Full time", "PT": "Part time"}}).collect()
    assert [r["kind"] for r in b] == ["Full time", "Part time"]


def test_lab(spark):
    r = spark.createDataFrame([("b1", "25C", 0, 1.0), ("b1", "25C", 3, 2.0), ("b1", "25C", 6, 3.0), ("b2", "25C", 0, 1.0)], "b string, c string, m int, v double")
    assert [(x["b"], x["missing"]) for x in lab.stability_holes(r, "b", "c", "m").collect()] == [("b2", [3, 6])]
    t = lab.trends(r, ["b", "c"], "m", "v", 5.0).first()
    assert t["crosses_at"] == pytest.approx(12.0) and t["flagged"]
    f = lab.finding(r.limit(1), "X", "warning", F.lit("m")).unionByName(lab.finding(r.limit(1), "Y", "blocker", F.lit("m")))
    assert [x["code"] for x in lab.findings(f).collect()] == ["Y", "X"]
    bad = text_checks.run({"ok": lambda: lab.finding(r.limit(1), "X", "warning", F.lit("m")), "broken": lambda: 1 / 0}).collect()
    assert [x["code"] for x in bad] == ["QC_CHECK_FAILED", "X"]


def test_privacy(spark):
    t = "Dr. Jane Doe wrote to jane@example.org, phone +44 20 7946 0958, born on 1980-01-02."
    kinds = {x["kind"] for x in privacy.detect_in(t) if x["confidence"] >= privacy.HIGH}
    assert {"email", "phone", "date_of_birth", "reporter_name"} <= kinds
    masked = privacy.mask_in(t, "s")
    assert "jane@" not in masked and "[EMAIL-" in masked and privacy.mask_in(t, "s") == masked != privacy.mask_in(t, "other")
    df = spark.createDataFrame([(t,), (None,), ("",)], "t string")
    assert [r["m"] for r in df.select(privacy.mask(F.col("t"), "s").alias("m")).collect()] == [masked, None, ""]
    assert privacy.classify_column("base_salary", []) == "money" and privacy.classify_column("x", ["a@b.co"]) == "email"


def test_clusters_and_lifecycle(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (5, 6)], "a long, b long")
    assert {(r["node"], r["component"]) for r in clusters.components(e).collect()} == {(1, 1), (2, 1), (3, 1), (5, 5), (6, 5)}
    assert lifecycle.canonical_hash({"a": 3.0, "b": None}) == lifecycle.canonical_hash({"b": None, "a": 3}) != lifecycle.canonical_hash({"a": "3", "b": None})
    with pytest.raises(ValueError):
        lifecycle.canonical_hash(float("nan"))
    kept, counts, digest = lifecycle.offboard({"t": spark.createDataFrame([("a",), ("b",)], "org_id string")}, "a")
    assert counts == {"t": 1} and kept["t"].count() == 1 and len(digest) == 64


def test_token_bucket():
    tokens, at, seen = 2.0, None, []
    for now in (0.0, 0.0, 0.0, 1.0, 1.0):
        tokens, ok, at = admit(tokens, at, now, 2.0, 1.0)
        seen.append(ok)
    assert seen == [True, True, False, True, False]
