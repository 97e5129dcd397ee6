from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tabloom.functions import dates, scores, text, values


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("cell", ["0.050", "12.30", "1234.5678", "0.00012345", "100.0", "0.10", "98.000"])
def test_reported_text_stays(spark, cell):
    v = one(spark, values.parse_value(F.lit(cell)))
    assert v["text"] == cell and v["operator"] == "eq" and v["number"] == Decimal(cell)


@pytest.mark.parametrize(
    ("cell", "operator", "number", "low", "high", "unit"),
    [
        ("NMT 0.2 %", "nmt", "0.2", None, None, "%"), ("< 0.05", "lt", "0.05", None, None, None), ("98.0 - 102.0 %", "range", None, "98.0", "102.0", "%"), ("0.5 % w/w", "eq", "0.5", None, None, "% w/w"),
        ("Complies", "text", None, None, None, None), ("N/D", "nd", None, None, None, None), ("1,5", "text", None, None, None, None), ("1,234 mg", "eq", "1234", None, None, "mg"), ("", "text", None, None, None, None),
        ("Complies with USP <711>", "text", None, None, None, None), ("not less than 98.0", "nlt", "98.0", None, None, None),
    ],
)
def test_parse_value(spark, cell, operator, number, low, high, unit):
    v = one(spark, values.parse_value(F.lit(cell)))
    dec = lambda x: None if x is None else Decimal(x)
    assert (v["operator"], v["number"], v["low"], v["high"], v["unit"]) == (operator, dec(number), dec(low), dec(high), unit)


@pytest.mark.parametrize(
    ("result", "criterion", "outcome"),
    [
        ("0.5 %", "NMT 3000 ppm", "FAIL"), ("3000 ppm", "NMT 0.5 %", "PASS"), ("500 mg", "NLT 0.4 g", "PASS"), ("0.0001 g", "NLT 5 mg", "FAIL"), ("5 mL", "NMT 5 mg", "UNKNOWN"), ("99.2", "98.0 - 102.0 %", "PASS"), ("97.9", "98.0 - 102.0 %", "FAIL"),
        ("ND", "NMT 0.1 %", "PASS"), ("ND", "NLT 0.1 %", "UNKNOWN"), ("Complies", "Complies", "PASS"), ("", "NMT 1", "UNKNOWN"), ("3 cfu/g", "NMT 10 cfu/g", "PASS"), ("3 cfu/g", "NMT 10 cfu/mL", "UNKNOWN"),
    ],
)
def test_compare(spark, result, criterion, outcome):
    assert one(spark, values.compare(values.parse_value(F.lit(result)), values.parse_criterion(F.lit(criterion))))["outcome"] == outcome


def test_disproportionality(spark):
    m = scores.disproportionality(*[F.lit(x) for x in (10, 90, 20, 980)])
    r = spark.range(1).select(*[c.alias(n) for n, c in m.items()]).first()
    assert r["prr"] == pytest.approx(5.0) and r["ror"] == pytest.approx(9800 / 1800) and r["meets_evans"] and r["ror_above_one"]
    for cells, note in (((0, 9, 9, 9), "not reported with"), ((9, 9, 0, 9), "not reported in"), ((9, 0, 9, 9), "every case"), ((9, 9, 9, 0), "every background")):
        m = scores.disproportionality(*[F.lit(x) for x in cells])
        assert note in " ".join(one(spark, m["notes"]))
    assert not one(spark, scores.disproportionality(*[F.lit(x) for x in (2, 1, 1, 5000)])["meets_evans"])


@pytest.mark.parametrize(("cell", "value", "reason"), [("2026-03-04", "2026-03-04", None), ("20260304", "2026-03-04", None), ("4-Mar-26", "2026-03-04", None), ("13/04/2026", "2026-04-13", None), ("03/04/2026", None, "ambiguous"), ("soon", None, "unreadable"), ("", None, None)])
def test_dates(spark, cell, value, reason):
    p = one(spark, dates.parse_ordered(F.lit(cell)))
    assert (str(p["value"]) if p["value"] else None, p["reason"]) == (value, reason)
    if reason == "ambiguous":
        assert str(one(spark, dates.parse_ordered(F.lit(cell), "day_first"))["value"]) == "2026-04-03"


def test_text(spark):
    assert one(spark, text.slug(F.lit(" Employee ID! "))) == "employee_id"
    assert one(spark, text.normalise_words(F.lit("Naïve__Wörd-x"))) == "naïve wörd x"
    assert one(spark, text.rank_tokens(F.lit("The table 14.1.2 of Patients"))) == ["table", "14.1.2", "patients"]
    assert one(spark, text.in_id_range(F.lit("14.10"), "14.1")) is False and one(spark, text.in_id_range(F.lit("14.1.3"), "14.1")) is True
    assert one(spark, text.doubled_words(F.lit("the The cat sat sat down"))) == ["the", "sat"]
    assert one(spark, text.capped_names(F.array(*[F.lit(str(i)) for i in range(8)]))).endswith("and 2 more")
    assert one(spark, text.citations(F.lit("rose [S1, p.4] and [S2]"))) == [("S1", 4), ("S2", None)]
    assert one(spark, text.sentences(F.lit("See e.g. Table 2. It rose by 1.5 mg. Done."))) == ["See e.g. Table 2.", "It rose by 1.5 mg.", "Done."]
    assert one(spark, text.korean_particles(F.lit("책을(를) 나무은(는)"))) == "책을 나무는"
    assert one(spark, text.fuzzy_ratio(F.lit("employment_start"), F.lit("employment_start_date"))) == pytest.approx(16 / 21)
    assert [tuple(x) for x in one(spark, text.word_diff(F.lit("a b c"), F.lit("a x c")))] == [("equal", "a"), ("delete", "b"), ("insert", "x"), ("equal", "c")]
