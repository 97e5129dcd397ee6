"""Exact dedup with a split of heavy hitters, against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tabloom.llm.heavy_dedup import HeavyDedup, heavy_keys, merge_summaries
from tabloom.llm.common import Scratch

DOCS = "doc_id long, text string, kept string, digest string, n long, at long"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[lower(t)].append(i)
    below = lambda i: (i is not None, i or 0)
    out = []
    for t, ids in groups.items():
        last = max(ids, key=below)
        left = 1
        for i in sorted(ids, key=below, reverse=True):
            out.append((i, last, len(ids), i == last and left == 1, hashlib.sha256(t.encode()).hexdigest()))
            left = 0 if i == last else left
    return sorted(out, key=repr)


@pytest.mark.parametrize("counters", [1, 3, 1024])
def test_equals_brute_force(spark, counters):
    texts = [None, "", "a", "A", "Ä", "ä", "x" * 100_000, "X" * 100_000] + ["Hot text"] * 40 + ["hot TEXT"] * 20 + ["warm"] * 15 + [f"t{i % 30}" for i in range(60)]
    rows = list(enumerate(texts)) + [(50, "Hot text"), (None, "warm"), (None, "only without an id")]
    df = spark.createDataFrame([(i, t, "clash", "clash", 7, 8) for i, t in rows], DOCS).repartition(5)
    got = HeavyDedup(df, counters=counters).run()
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)
    whole = HeavyDedup(df, counters=counters).run(whole_rows=True)
    assert whole.columns == ["doc_id", "text", "digest", "n", "at", "keep_id", "group_size", "kept", "text_sha256"]
    assert whole.where("kept").count() == len({lower(t) for _, t in rows}) and whole.where("digest = 'clash' and at = 8").count() == len(rows)


def test_winners_are_broadcast_and_the_rest_is_shuffled(spark):
    df = spark.createDataFrame([(i, "hot" if i % 2 else f"t{i // 4}") for i in range(400)], "doc_id long, text string").repartition(6)
    op = HeavyDedup(df, counters=3)
    op.run().collect()
    assert [r["n"] for r in op.scratch.table("winners").collect()] == [200]
    op.close()


def test_empty(spark):
    assert HeavyDedup(spark.createDataFrame([], "doc_id long, text string")).run().collect() == []


def test_frequent_keys_survive_merging(spark):
    rng = np.random.default_rng(3)
    keys = np.concatenate([np.full(400, 7), np.full(250, 9), rng.integers(100, 10_000, 1000)]).astype(np.int64)
    rng.shuffle(keys)
    for counters in (4, 9):
        left, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for part in np.array_split(keys, 13):
            left, n = merge_summaries(np.concatenate([left, part]), np.concatenate([n, np.ones(len(part), np.int64)]), counters)
        true = Counter(keys.tolist())
        assert len(left) <= counters and {k for k, v in true.items() if v > len(keys) / (counters + 1)} <= set(left.tolist())
        assert all(true[k] - len(keys) / (counters + 1) <= v <= true[k] for k, v in zip(left.tolist(), n.tolist(), strict=True))
        got = heavy_keys(spark.createDataFrame([(int(k),) for k in keys], "key long").repartition(70), counters, Scratch(spark, "mg")).collect()
        assert len(got) <= counters and {k for k, v in true.items() if v > len(keys) / (counters + 1)} <= {r["key"] for r in got}
