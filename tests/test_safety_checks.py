from datetime import date

from pyspark.sql import functions as F

from tabloom.operators import metrics, safety_checks as s


def codes(df):
    return sorted((r["code"], r["message"]) for r in df.collect())


def test_checks(spark):
    counts = spark.createDataFrame([(10, 5, 2, 2)], "summary int, listed int, unassessed int, unrelated int")
    assert codes(s.reconciliation(counts)) == [("RECONCILIATION", "summary 10, listed 5, unassessed 2, unrelated 2")] and s.reconciliation(counts.withColumn("summary", F.lit(9))).count() == 0
    r = spark.createDataFrame([("p", 1, 5, 20), ("p", 2, 30, 25), ("p", 3, 1, 24)], "product string, sequence int, interval int, cumulative int")
    assert codes(s.window_sanity(r)) == [("CUMULATIVE_BELOW_INTERVAL", "report 2"), ("CUMULATIVE_FELL", "report 3")]
    assert [x["change"] for x in s.volume_trend(r).orderBy("sequence").collect()] == [None, 5.0, -29 / 30]
    e = spark.createDataFrame([("c", 1, "27.0", True, "u", "v1"), ("d", 2, "26.1", False, "u", "v2")], "case_id string, event_id int, dictionary_version string, coding_required boolean, confirmed_by string, rsi_version string")
    assert codes(s.one_dictionary(e, "27.0")) == [("DICTIONARY_VERSION", "26.1, 27.0")] and s.one_dictionary(e.where("event_id = 1"), "27.0").count() == 0
    assert codes(s.uncoded(e, e.select("case_id"))) == [("UNCODED_EVENTS", "1")] and codes(s.stale_expectedness(e, "v1")) == [("RSI_VERSION", "2")]
    c = spark.createDataFrame([("a", ["death"], []), ("b", [], ["rash"]), ("c", None, None)], "case_id string, seriousness_criteria array<string>, terms array<string>")
    assert codes(s.narratives_missing(c, spark.createDataFrame([("a",)], "case_id string"), ["rash"])) == [("NARRATIVE_MISSING", "b")]
    sig = spark.createDataFrame([(1, None, None, date(2026, 1, 1)), (2, "closed", " ", date(2026, 1, 1)), (3, "candidate", None, date(2026, 1, 1))], "signal_id int, status string, conclusion string, detected_on date")
    assert [x for x, _ in codes(s.signal_hygiene(sig, date(2026, 7, 1)))] == ["SIGNAL_CLOSED_INCOMPLETE", "SIGNAL_NO_STATUS", "SIGNAL_UNTRIAGED"]
    sec = spark.createDataFrame([("1", "There were 12 cases and 1,300 reports [TABLE: x] [DATA NEEDED: age] per 1,000 patients")], "section string, content string")
    cells = spark.createDataFrame([(["12", "n"],)], "cells array<string>")
    assert {x["figure"] for x in s.unsourced_figures(sec, cells).collect()} == {"1300", "1000"}
    assert codes(s.markers(sec, ["y"])) == [("DATA_NEEDED", "age"), ("TABLE_UNKNOWN", "x")]
    assert s.rates_without_exposure(sec, spark.createDataFrame([(False,)], "confirmed boolean")).count() == 1
    acts = spark.createDataFrame([("label_change", date(2026, 5, 1))], "kind string, action_date date")
    assert s.label_continuity(acts, spark.createDataFrame([(date(2026, 4, 1),)], "effective date")).count() == 1 and s.label_continuity(acts, spark.createDataFrame([(date(2026, 6, 1),)], "effective date")).count() == 0
    now = spark.createDataFrame([("a", 1), ("b", 3)], "key string, value int")
    assert codes(s.figure_drift(spark.createDataFrame([("a", 1), ("b", 2), ("c", 4)], "key string, value int"), now)) == [("FIGURE_CHANGED", "b"), ("FIGURE_CHANGED", "c")]
    assert codes(s.regions_due(spark.createDataFrame([(["eu", "us"], ["us"])], "targets array<string>, recorded array<string>"))) == [("REGION_DUE", "eu")]
    f = s.reconciliation(counts)
    assert s.downgrade(f, f).first()["severity"] == "warning"
    assert [x["concern"] for x in s.concern_table(spark.createDataFrame([("Missing information", "x"), ("Important identified risk", "y")], "category string, concern string")).collect()] == ["y", "x"]
    b = s.bound_cases(spark.createDataFrame([("a",), ("z",)], "case_id string"), c, F.lit("after_lock"))
    assert codes(b) == [("BOUND_CASE", "a after_lock"), ("BOUND_CASE", "z missing")]


def test_more_metrics(spark):
    g = spark.createDataFrame([(["a", "b"],)], "fields array<string>")
    none, some = spark.createDataFrame([(None,)], "found_after_approval boolean"), spark.createDataFrame([(True,), (False,)], "found_after_approval boolean")
    assert metrics.escaped_error_rate(g, none, g).first()["unavailable_reason"] == "nothing was reviewed after approval"
    assert metrics.escaped_error_rate(g, some, g).first()["value"] == 5000.0 and metrics.escaped_error_rate(g, some, g.where("false")).first()["value"] is None
    t = spark.createDataFrame([("a",), ("b",)], "template_id string")
    m = metrics.family_reuse_rate(t, t.where("template_id = 'a'").withColumn("approved", F.lit(True)))
    assert m.first()["value"] == 0.5 and metrics.all_metrics(m, m).count() == 2
    p = metrics.project_flags(spark.createDataFrame([(1,), (2,)], "project_id int"), {"drafts": spark.createDataFrame([(2,), (2,)], "project_id int")})
    assert {r["project_id"]: r["has_drafts"] for r in p.collect()} == {1: False, 2: True}
