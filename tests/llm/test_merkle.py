"""Merkle manifest against a plain version."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tabloom.llm import merkle

DOCS = "doc_id long, text string, lang string, source string, n_chars long, g string, digest string, idx int, path int"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels_of(nodes, run):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i : i + run]) for i in range(0, len(out[-1]), run)])
    return out


def proof(levels, at, run):
    for nodes in levels[:-1]:
        mine = at - at % run
        yield nodes[mine:at], nodes[at + 1 : mine + run]
        at //= run


def brute(rows, run):
    """Rows as (doc_id, leaf, subroot, root, proof, folded root)."""
    groups = defaultdict(list)
    for i, text, lang, source, n in rows:
        leaf = lambda n: sha(enc(i), enc(source), enc(lang), enc(n), enc(text))  # noqa: B023, E731
        groups[lang].append(((i is not None, i or 0), leaf(n), leaf(n + 1) if n is not None and i is not None and i % 3 == 0 else leaf(n), i))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort()
        trees[name] = levels_of([x[1] for x in groups[name]], run)
    top = levels_of([trees[n][-1][0] for n in names], run)
    out = []
    for k, name in enumerate(names):
        for at, (_, leaf, later, i) in enumerate(groups[name]):
            path = [*proof(trees[name], at, run), *proof(top, k, run)]
            folded = later
            for before, after in path:
                folded = sha(*before, folded, *after)
            out.append((i, leaf, trees[name][-1][0], top[-1][0], sha(*(x for p in path for side in p for x in side)), folded))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("run", "tier"), [(2, 10), (2, 2), (3, 1)])
def test_equals_brute_force(spark, monkeypatch, run, tier):
    monkeypatch.setattr(merkle, "TIER", tier)
    rows = [(i, ["a", "", None, "Ünï", "x" * 50_000][i % 5], "en", "s", 7) for i in range(1, 60)] + [(100 + i, "t", "de", None, None) for i in range(5)]
    rows += [(200, "alone", "fr", "s", 3), (201, "a", None, "s", 1), (203, "b", None, "s", 2), (204, None, "", None, 0), (None, "n", "en", "s", 1), (9, "same id", "en", "s", 1), (12, "a", "zé", "s", 7), (12, "a", "zé", "s", 7)]
    df = spark.createDataFrame([(*r, "clash", "clash", 1, 2) for r in rows], DOCS).repartition(3)
    op = merkle.MerkleManifest(df, run=run, changed={"n_chars": F.when(F.col("doc_id") % 3 == 0, F.col("n_chars") + 1)})
    found = op.proofs().withColumn("p", merkle.proof_digest())
    got = sorted((tuple(r[c] for c in ("id", "leaf", "subroot", "root", "p", "folded_root")) for r in found.collect()), key=repr)
    want = brute(rows, run)
    # Equal ids of a group are ordered by their leaves, nulls first: the same rule as in the plain version.
    assert got == want
    assert {(r["folded_root"] == r["root"], r["verified"]) for r in found.collect()} == {(True, True), (False, False)}
    nodes = op.nodes()
    assert nodes.where("tree = 'groups'").orderBy(F.desc("level")).first()["digest"] == want[0][3]
    assert nodes.where("tree = 'rows' and grp is null and level = 0").count() == 2
    op.close()


def test_empty_and_single(spark):
    empty = spark.createDataFrame([], DOCS)
    assert merkle.MerkleManifest(empty).proofs().collect() == []
    one = merkle.MerkleManifest(spark.createDataFrame([(1, "a", "en", "s", 1, "", "", 1, 1)], DOCS)).proofs().first()
    assert one["leaf"] == one["subroot"] == one["root"] == one["folded_root"] and one["path"] == [] and one["verified"]


def test_many_equal_rows_make_no_hot_task(spark):
    rows = [(1, "a", "en", "s", 1)] * 3000
    got = merkle.MerkleManifest(spark.createDataFrame([(*r, "", "", 1, 1) for r in rows], DOCS).repartition(4)).proofs()
    assert got.count() == 3000 and got.where("not verified").count() == 0 and got.select("root").distinct().count() == 1
