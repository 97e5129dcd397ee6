"""Operators whose queries cannot show refusals, hooks and edges."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.functions import dates, scores, values
from tabloom.operators import conditions, joins, lab, privacy, resolution, retrieval, safety_checks, text_checks, usage
from tabloom.operators.registry import Registry


def kinds(t, **k):
    return [(x["kind"], x["text"]) for x in privacy.detect_in(t, **k)]


@pytest.mark.parametrize(
    ("said", "found"),
    [
        ("Write to alan.reed+x@mail.example.co.uk.", [("email", "alan.reed+x@mail.example.co.uk")]), ("a@b, @c.org, d@e.f", []), ("x@y.org@z.com", [("email", "x@y.org")]),
        ("NHS number 943 476 5919 and MRN: 00123-45", [("national_id", "943 476 5919"), ("national_id", "00123-45")]), ("national insurance QQ123456C", [("national_id", "QQ123456C")]),
        ("call +44 20 7946 0958 or (020) 7946 0958", [("phone", "+44 20 7946 0958"), ("phone", "(020) 7946 0958")]), ("lot 2024-05-06, ratio 12/3456-7890", []),
        ("DOB: 3/4/1985; born on 12 March 1970", [("date_of_birth", "3/4/1985"), ("date_of_birth", "12 March 1970")]), ("onset 12 March 1970", []),
        ("Professor Maria de la Cruz saw Doctor Ludwig van Beethoven", [("reporter_name", "Maria de la Cruz"), ("reporter_name", "Ludwig van Beethoven")]),
        ("at the Royal Medical Centre and Kent NHS Trust", [("site_name", "Royal Medical Centre"), ("site_name", "Kent NHS Trust")]), ("lives at 221B Baker Street, 7 Mill Terrace, SW1A 1AA", [("address", "221B Baker Street"), ("address", "7 Mill Terrace"), ("address", "SW1A 1AA")]),
        ("Severe Headache, Data Lock Point, United Kingdom, Monday March", []), ("so Jane Smith came", [("patient_name", "Jane Smith")]), ("", []),
    ],
)
def test_personal_data(said, found):
    assert kinds(said) == found


def test_known_values_and_answers():
    assert kinds("jane SMITH called", known={"Jane Smith": "patient_name"}) == [("patient_name", "jane SMITH")]
    masked = privacy.mask_in("so Jane Smith and Big Ben", "s", accept={"jane smith": "patient_name", "big ben": None})
    assert masked.startswith("so [PATIENT-") and masked.endswith("and Big Ben")


def test_canary_gate_and_policy(spark):
    rows = spark.range(10).withColumnRenamed("id", "k")
    good = usage.canary_run(rows, "k", lambda d: d.withColumn("ok", F.lit(True)), ~F.col("ok"))
    assert good.count() == 10 and sorted(r["k"] for r in good.where("canary").collect()) == [0, 3, 6]
    assert usage.canary_run(rows.limit(0), "k", lambda d: d.withColumn("ok", F.lit(True)), ~F.col("ok")).count() == 0
    policy = usage.RowPolicy({"t": rows.withColumn("org_id", (F.col("k") % 2).cast("string"))}, "1")
    assert policy.read("t").count() == 5
    policy.register("mine_")
    assert spark.sql("select count(*) from mine_t").first()[0] == 5
    with pytest.raises(KeyError):
        policy.read("u")
    with pytest.raises(ValueError):
        usage.RowPolicy({}, " ") and usage.tenant_scope(rows, " ")


def test_refusals(spark):
    with pytest.raises(retrieval.ProviderMismatch):
        retrieval.same_provider(spark.createDataFrame([(1, "p2")], "id int, provider string"), "p1")
    with pytest.raises(ValueError):
        lab.render("no_table")
    with pytest.raises(ValueError):
        dates.format_locale(F.lit(None), "xx")
    with pytest.raises(ValueError):
        scores.similar_pairs(spark.range(1), "id", "id", 0.5)
    r = Registry()
    r.add("a", lambda: 1)
    assert r.call("a") == 1
    with pytest.raises(KeyError):
        r.call("b")
    with pytest.raises(ValueError):
        r.add("a", lambda: 2)


def test_failing_checks_are_blockers(spark):
    """One fails while it is planned, one while it runs."""
    boom = F.udf(lambda x: 1 // 0, "string")
    late = lambda: spark.range(1).select(F.lit("A").alias("code"), F.lit("info").alias("severity"), boom("id").alias("message"))
    fine = lambda: spark.range(1).select(F.lit("B").alias("code"), F.lit("warning").alias("severity"), F.lit("m").alias("message"))
    out = text_checks.run({"late": late, "early": lambda: 1 // 0, "fine": fine}).collect()
    assert [(r["code"], r["severity"]) for r in out] == [("QC_CHECK_FAILED", "blocker"), ("QC_CHECK_FAILED", "blocker"), ("B", "warning")]
    accepted = spark.createDataFrame([("QC_CHECK_FAILED", out[0]["message"])], "code string, message string")
    assert [r["severity"] for r in safety_checks.quality_run({"late": late, "early": lambda: 1 // 0}, accepted).collect()] == ["blocker", "warning"]


def test_vectors_and_nearest(spark):
    bad = spark.createDataFrame([("[1.0, 2.0]",), ("[1.0]",), ("x",), (None,)], "v string")
    assert [r["v"] for r in bad.select(retrieval.read_vector(F.col("v"), 2).alias("v")).collect()] == [[1.0, 2.0], None, None, None]
    v = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(30)] + [(90, None), (91, [0.0, 0.0])], "id long, e array<double>")
    got = retrieval.cosine_top_k_each(v.where("id in (0, 1)"), v, 2, "id", "e").orderBy("q", "rank").collect()
    assert [(r["q"], r["id"], r["rank"]) for r in got] == [(0, 3, 1), (0, 6, 2), (1, 4, 1), (1, 7, 2)]
    assert retrieval.cosine_top_k_each(v.where("false"), v, 2, "id", "e").count() == 0


def test_modal_factor_and_conformance(spark):
    f = spark.createDataFrame([("g", i, x) for i, x in enumerate([1.0, 1.0005, 1.0009, 5.0, -2.0, -2.0, 0.0])] + [("h", 0, None)], "g string, i int, f double")
    got = lab.modal_factor(f, ["g"], "i", "f").orderBy("i").collect()
    assert {r["modal"] for r in got} == {1.0} and [r["agrees"] for r in got] == [True, True, True, False, False, False, False]
    r = spark.createDataFrame([("5 mg", "NMT 6 mg"), ("5 mg", "NMT 6 mg"), (None, "NMT 6 mg"), ("7 mg", None)], "value_text string, criterion string")
    assert sorted(x["outcome"] for x in lab.conformance(r).collect()) == ["PASS", "PASS", "UNKNOWN", "UNKNOWN"]


def test_test_lookup(spark):
    tests = spark.createDataFrame([("m", "Assay", 1), ("m", "Assay by HPLC", 2), ("n", "pH value", 3)], "material string, name string, id int")
    rows = spark.createDataFrame([("m", "ASSAY"), ("m", "Assay by HP"), ("n", "pH value at 25"), ("n", "as"), ("m", None)], "material string, name string")
    assert {(r["name"], r["test_id"]) for r in lab.test_for(rows, tests, "material", "name", "id").collect()} == {("ASSAY", 1), ("Assay by HP", 2), ("pH value at 25", 3), ("as", None), (None, None)}


def test_hashes_and_hooks(spark):
    assert conditions.expression_hash("a  ==  'X'") == conditions.expression_hash("a == 'X'") != conditions.expression_hash("a == 'x'")
    units = [resolution.Unit("note", "human", "")]
    d = spark.range(2)
    assert [r["note"] for r in resolution.resolve_hooked(d, units).collect()] == [None, None]
    assert [r["note"] for r in resolution.resolve_hooked(d, units, lambda u: F.concat(F.lit(u), F.col("id").cast("string"))).orderBy("id").collect()] == ["note0", "note1"]


def test_small_and_shared(spark):
    assert "broadcast" in joins.small(spark.range(3))._jdf.queryExecution().toString().lower()
    assert "broadcast" not in joins.small(spark.range(30), 10)._jdf.queryExecution().analyzed().toString().lower()
    assert joins.stored(spark.range(5), "t").count() == 5


@pytest.mark.parametrize(("locale", "said"), [("en", "$1,234.50"), ("de_DE", "1.234,50 €"), ("fr", "1 234,50 €")])
def test_money(spark, locale, said):
    symbol = "$" if locale == "en" else "€"
    assert spark.range(1).select(values.format_money(F.lit(1234.5), symbol, locale).alias("x")).first()["x"] == said


@pytest.mark.parametrize(
    ("cell", "want"),
    [("10 to 20 mg/mL", ("range", 10, 20, "mg/mL")), ("-5 - -2 °C", ("range", -5, -2, "°C")), ("1,000–2,000", ("range", 1000, 2000, None)), ("5-", ("eq", 5, None, "-")), ("≤ 0.5 % w/w", ("lte", 0.5, None, "% w/w")), ("1.2.3", ("text", None, None, None)), ("12,34", ("text", None, None, None)), (".5 mg", ("eq", 0.5, None, "mg")), ("2.0 × 10", ("eq", 2, None, "× 10"))],
)
def test_reading_values(spark, cell, want):
    v = spark.range(1).select(values.parse_value(F.lit(cell)).alias("v")).first()["v"]
    first = v["low"] if v["operator"] == "range" else v["number"]
    assert (v["operator"], None if first is None else float(first), None if v["high"] is None else float(v["high"]), v["unit"]) == want


def test_lost_values(spark):
    r = np.random.default_rng(8)
    letters = np.array(list("ab é𝄞\t"))
    word = lambda most: "".join(r.choice(letters, r.integers(0, most)))
    told = [(int(r.integers(0, 3)), word(40)) for _ in range(40)] + [(0, "xy" * 300 + "ab" * 200), (1, None), (None, "ab"), (7, "")]
    values = [(int(r.integers(0, 4)), word(7)) for _ in range(150)] + [(0, "xy" * n + "ab" * m) for n, m in ((32, 1), (200, 99), (301, 0), (300, 200), (1, 201))] + [(None, "ab"), (1, None), (2, "\t")]
    squeeze = lambda t: re.sub(r"[ \t\n\x0b\f\r]+", " ", t.strip(" "))
    want = [(d, v) for d, v in values if v and v.strip(" ") and not any(d is not None and d == e and t is not None and squeeze(v) in squeeze(t) for e, t in told)]
    v, t = spark.createDataFrame(values, "doc int, value string"), spark.createDataFrame(told, "doc long, text string")
    found = text_checks.lost_values(v, t, "doc", "value", "text")
    assert Counter(map(tuple, found.collect())) == Counter(want) and 5 < len(want) < len(values) and found.columns == ["doc", "value"]
    assert text_checks.lost_values(v.where("doc is null"), t, "doc", "value", "text").count() == 1
    # No text of a whole document is put together.
    assert "collect_list" not in found._jdf.queryExecution().optimizedPlan().toString()
