"""One-to-one assignment, headers of listings, the tenants' vector store and its index."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.operators import lifecycle, listings, resolution, usage
from tabloom.operators.vector_store import PivotIndex, VectorStore


def in_turn(pairs):
    best = {}
    for t, c, s in pairs:
        best.setdefault(t, {})[c] = max(s, best.get(t, {}).get(c, s))
    taken, out = set(), set()
    for t in sorted(best, key=lambda t: (-max(best[t].values()), t)):
        left = sorted((-s, c) for c, s in best[t].items() if c not in taken)
        if left:
            taken.add(left[0][1])
            out.add((t, left[0][1]))
    return out


def test_targets_choose_by_their_best_score(spark):
    rows = [("T1", "c1", 0.9), ("T1", "c2", 0.1), ("T2", "c1", 0.8), ("T2", "c2", 0.2), ("T3", "c2", 0.7), ("T4", "c9", None)]
    got = lambda r: {(x["target"], x["column"]) for x in resolution.assign(spark.createDataFrame([(*x, "b") for x in r], "target string, column string, score double, band string")).collect()}
    assert got(rows) == {("T1", "c1"), ("T2", "c2")} and got([]) == set()
    r = np.random.default_rng(2)
    many = [(f"T{t}", f"c{c}", float(r.integers(0, 9)) / 9) for t in range(40) for c in r.integers(0, 25, 6)]
    chain = [(f"T{i:02}", f"c{i + j:02}", (100 - i - j / 2) / 100) for i in range(12) for j in (0, 1)] + [(f"T{i:02}", "c00", 0.995) for i in range(12)]
    assert got(many) == in_turn(many) and got(chain) == in_turn(chain)


def test_headers_by_whole_words(spark):
    heads = ["Case ID", "Local case ID", "Dosage", "Description", "case-id", None, "Worldwide Case Number (all)"]
    df = spark.createDataFrame([("s", i, h) for i, h in enumerate(heads)], "source string, place int, header string")
    got = [(r["field"], r["confidence"]) for r in listings.suggest_fields(df).orderBy("place").collect()]
    assert got == [("worldwide_case_id", 1.0), ("local_case_id", 1.0), (None, 0.0), (None, 0.0), (None, 0.0), (None, 0.0), (None, 0.0)]
    assert listings.suggest_fields(df.where("false")).count() == 0
    faults = listings.mapping_faults(spark.createDataFrame([("s", "a", "country"), ("s", "b", "country"), ("s", "c", "shoe"), ("t", "a", "worldwide_case_id"), ("t", "b", None)], "source string, column string, field string"))
    assert {tuple(r) for r in faults.collect()} == {("s", "missing", "worldwide_case_id"), ("s", "unknown", "shoe"), ("s", "duplicate", "country")}


def test_vector_store(spark, tmp_path):
    kind = "org string, id string, embedding array<double>, provider string"
    rows = lambda *r: spark.createDataFrame([(o, i, v, "p") for o, i, v in r], kind)
    store = VectorStore(spark, str(tmp_path / "v"), 4)
    assert store.rows("a").collect() == []
    store.put(rows(*[("a", f"r{k}", [1.0, float(k)]) for k in range(9)], ("b", "r1", [0.0, 1.0]), ("b", "zero", [0.0, 0.0])))
    store.put(rows(("a", "r1", [5.0, 5.0])))
    store.put(rows(("a", "r1", [-1.0, 0.0])))
    assert store.version() == 3 and [r["embedding"] for r in store.rows("b").where("id = 'r1'").collect()] == [[0.0, 1.0]]
    assert [r["embedding"] for r in store.rows("a").where("id = 'r1'").collect()] == [[-1.0, 0.0]] and store.rows("a").count() == 9
    # A put writes the buckets that it touches, and no others.
    assert len(set(store._places(3).values())) > 1 and list(store._places(3).values()).count(3) == 1
    assert [r["id"] for r in store.nearest("a", [1.0, 0.0], "p", 2).collect()] == ["r0", "r2"] and [r["id"] for r in store.nearest("b", [1.0, 0.0], "p", 5).collect()] == ["r1"]
    store.remove(rows(("a", "r0", None), ("a", "none", None)))
    assert store.rows("a").count() == 8
    for bad in (rows(("a", "x", [1.0]), ("a", "x", [2.0])), rows((None, "x", [1.0]))):
        with pytest.raises(ValueError):
            store.put(bad)


def test_pivot_index_opens_few_cells(spark, tmp_path):
    r = np.random.default_rng(7)
    x = np.repeat(r.normal(size=(20, 8)), 40, axis=0) + r.normal(size=(800, 8)) * 0.02
    data = [(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 8)] + [(1000 + i, [float(c) for c in x[5]]) for i in range(5)]
    df = spark.createDataFrame(data, "id long, embedding array<double>")
    index = PivotIndex(spark, str(tmp_path / "i")).build(df, pivots=30)
    v = np.array([d[1] for d in data if d[1] is not None and any(d[1])])
    ids = np.array([d[0] for d in data if d[1] is not None and any(d[1])])
    for q, k in ((x[5], 7), (x[700] + 0.01, 30), (-x[3], 3), (x[1], 2000)):
        s = v @ q / np.sqrt((v * v).sum(axis=1) * (q @ q))
        want = sorted(zip((-s).round(12), ids.tolist(), strict=True))[:k]
        got = [(r["id"], r["score"]) for r in index.search(q, k).collect()]
        assert {i for i, _ in got} == {i for _, i in want} or np.allclose(sorted(-c for _, c in got), [c for c, _ in want])
        assert k == 2000 or len(index.opened) < 25
    index.search(x[5], 7)
    assert len(index.opened) <= 6


def test_retirement_follows_all_keys(spark):
    """Tables that refer to each other and to themselves, against a plain closure."""
    r = np.random.default_rng(4)
    a = [(i, int(r.integers(0, 40)) if i % 3 else None, bool(i % 5 == 0)) for i in range(40)]
    b = [(100 + i, int(r.integers(0, 40)), 100 + int(r.integers(0, 60)) if i % 4 == 1 else None) for i in range(60)]
    c = [(i, 100 + int(r.integers(0, 60))) for i in range(30)] + [(None, 100)]
    ta, tb, tc = spark.createDataFrame(a, "id long, boss long, old boolean"), spark.createDataFrame(b, "id long, owner long, twin long"), spark.createDataFrame(c, "id long, of long")
    tables = {"a": (ta, "id"), "b": (tb, "id"), "c": (tc, "id"), "d": (tc, "id")}
    links = [("a", "boss", "a"), ("b", "owner", "a"), ("b", "twin", "b"), ("c", "of", "b")]
    out = lifecycle.retire(tables, links, {"a": F.col("old")})
    gone = {"a": {i for i, _, old in a if old}, "b": set(), "c": set()}
    for _ in range(100):
        gone["a"] |= {i for i, boss, _ in a if boss in gone["a"]}
        gone["b"] |= {i for i, o, t in b if o in gone["a"] or t in gone["b"]}
        gone["c"] |= {i for i, o in c if i is not None and o in gone["b"]}
    got = out.manifest.collect()
    assert {(x["table"], int(x["id"])) for x in got} == {(n, i) for n, ids in gone.items() for i in ids}
    assert out.counts() == {n: len(v) for n, v in gone.items() if v} and out.kept["a"].count() == 40 - len(gone["a"]) and out.kept["d"].count() == 31
    step = {x["table"]: x["step"] for x in got}
    assert step["c"] < step["b"] < step["a"] and len(out.digest()) == 64
    with pytest.raises(ValueError, match="x"):
        lifecycle.retire(tables, [("x", "of", "a")], {})


def test_rows_at_places(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7 % 1000).alias("k")).repartition(5)
    at = lambda *p: sorted(r["k"] for r in usage.rows_at(df, "k", lambda n: p).collect())
    assert at(0, 333, 666) == [0, 333, 666] and at(999) == [999] and at() == [] and usage.rows_at(df.where("false"), "k", lambda n: [0]).collect() == []
