"""Pair joins by signatures and prefixes against all pairs."""

import re
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.functions import scores
from tabloom.operators import safety

CASE = "case_id string, worldwide_case_id string, local_ids array<string>, country string, sex string, age double, qualification string, receipt_date date, terms array<string>, onsets array<date>, drugs array<string>"


def cases(n, seed):
    r = np.random.default_rng(seed)
    maybe = lambda v, p=0.2: None if r.random() < p else v
    some = lambda make, k: [make(int(x)) for x in r.integers(0, k, r.integers(0, 3))]
    day = lambda k: date(2024, 1, 1) + timedelta(days=k)
    return [
        (f"c{i}", maybe(f"W{r.integers(0, 25)}"), maybe(some("l{}".format, 40)), maybe("FR"), maybe("F"), maybe(float(r.integers(20, 30)) + float(r.choice([0.0, 0.5, 0.999]))), maybe("md"), maybe(day(int(r.integers(0, 9)))),
         maybe(some("t{}".format, 9)), maybe(some(day, 12)), maybe(some("d{}".format, 5)))
        for i in range(n)
    ]


@pytest.mark.parametrize(("least", "fields"), [(0.6, 2), (0.4, 2), (0.85, 4), (1.2, 2), (0.2, 1)])
def test_duplicate_cases(spark, least, fields):
    rows = cases(90, 3)
    meet = lambda x, y: bool(set(x or ()) & set(y or ()))
    same = lambda x, y: x is not None and x == y
    want = set()
    for x in rows:
        for y in rows:
            if x[0] < y[0]:
                m = {"worldwide_case_id": same(x[1], y[1]), "local_case_id": meet(x[2], y[2]), "country": same(x[3], y[3]), "patient_sex": same(x[4], y[4]), "patient_age": None not in (x[5], y[5]) and abs(x[5] - y[5]) <= 1, "reporter_qualification": same(x[6], y[6]),
                     "receipt_date": same(x[7], y[7]), "preferred_terms": meet(x[8], y[8]), "onset_date": meet(x[9], y[9]), "suspect_drug": meet(x[10], y[10])}
                score = round(sum(safety.WEIGHTS[k] for k, v in m.items() if v), 3)
                if ((m["country"] and m["patient_sex"]) or m["worldwide_case_id"] or m["local_case_id"]) and score >= least and sum(m.values()) >= fields:
                    want.add((x[0], y[0], score))
    got = {(r["a"], r["b"], r["score"]) for r in safety.duplicate_pairs(spark.createDataFrame(rows, CASE), least, fields).collect()}
    assert got == want and want


def test_a_country_does_not_meet_itself(spark):
    """2,000 cases of one country and sex: the pairs that meet are hardly more than those that count."""
    rows = [(f"c{i}", None, [], "FR", "F", float(i % 90), "md", date(2024, 1, 1) + timedelta(days=i % 97), [f"t{i % 101}"], [], ["d"]) for i in range(2000)]
    df = spark.createDataFrame(rows, CASE)
    keys = df.select("case_id", F.explode(safety._keys(df, safety.signatures(0.6, 2))).alias("block")).groupBy("block").count()
    met = keys.select(F.sum(F.col("count") * (F.col("count") - 1) / 2)).first()[0]
    counted = safety.duplicate_pairs(df).count()
    assert counted <= met < 3 * counted < 2000 * 1999 / 2 / 10


@pytest.mark.parametrize("least", [0.56, 0.6, 0.75, 0.92])
def test_similar_templates(spark, least):
    r = np.random.default_rng(5)
    pick = lambda name, k, most: [f"{name}{x}" for x in sorted(set(r.integers(0, k, r.integers(0, most)).tolist()))]
    rows = [(i, (pick("c", 12, 6), pick("b", 5, 4), int(r.integers(0, 3)), int(r.integers(0, 3)), int(r.integers(0, 2)), 1)) for i in range(70)]
    rows += [(100 + i, s) for i, s in rows[::7]]
    df = spark.createDataFrame(rows, "k int, s struct<codes: array<string>, brackets: array<string>, paragraph_band: int, table_paragraphs: int, blue_spans: int, red_spans: int>")
    every = df.select(F.col("k").alias("a"), F.col("s").alias("sa")).join(df.select(F.col("k").alias("b"), F.col("s").alias("sb")), F.col("a") < F.col("b"))
    want = {tuple(x) for x in every.select("a", "b", scores.structural_similarity(F.col("sa"), F.col("sb")).alias("score")).where(F.col("score") >= least).collect()}
    assert {tuple(x) for x in scores.similar_pairs(df, "k", "s", least).collect()} == want and want


def test_pairs_of_cut_blocks(spark, monkeypatch):
    """Blocks in tiles give the pairs of whole blocks, each once, and ids may repeat."""
    df = spark.createDataFrame([*cases(60, 4), *cases(3, 5)], CASE)
    whole = safety.duplicate_pairs(df, 0.4).collect()
    monkeypatch.setattr(safety, "TILE", 4)
    assert sorted(map(tuple, safety.duplicate_pairs(df, 0.4).collect())) == sorted(map(tuple, whole)) and whole


def test_ages_at_the_tolerance_and_nulls_in_lists(spark):
    one = lambda i, age, local: (i, None, local, "FR", "F", age, None, None, [], [], [])
    rows = [one("a", 0.9999999999999999, [None, "x"]), one("b", 2.0, [None]), one("c", 9.0, ["y", None, "x", "z"]), one("d", 9.5, ["z", "x"])]
    got = {(r["a"], r["b"], r["score"], *r["matched_on"]) for r in safety.duplicate_pairs(spark.createDataFrame(rows, CASE), 0.4).collect()}
    many = ("local_case_id", "country", "patient_sex")
    assert got == {("a", "b", 0.4, "country", "patient_sex", "patient_age"), ("a", "c", 0.9, *many), ("a", "d", 0.9, *many), ("c", "d", 1.1, *many, "patient_age")}


def test_pairs_are_not_shuffled(spark):
    """Only cases move: pairs are as many as the square of a block, and nothing gathers them again."""
    plan = safety.duplicate_pairs(spark.createDataFrame(cases(40, 6), CASE))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(l_block#" in plan and not re.search(r"hashpartitioning\([ab]#", plan)


def test_ages_meet_by_cases_that_move_once_a_year(spark):
    """Pairs by age: a case moves for its own year and the next, and the pairs of a country of one age are not gathered by their ids."""
    rows = [(f"c{i:03}", None, None, "FR", "F", 40.0 + i % 2 / 2, None, None, None, None, None) for i in range(300)]
    found = safety.duplicate_pairs(spark.createDataFrame(rows, CASE), 0.4)
    assert found.count() == found.select("a", "b").distinct().count() == 300 * 299 // 2
    assert not re.search(r"hashpartitioning\([ab]#", found._jdf.queryExecution().executedPlan().toString())
