import re
from collections import Counter

import duckdb
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from tabloom.llm import mixing, quality
from tabloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, SF).cache()
        assert name == "sharding" or out.columns == docs.columns
        kept[name] = [r["doc_id"] for r in out.select("doc_id").collect()]
        docs = out
    assert len(kept["quality"]) > len(kept["near_duplicates"]) >= len(kept["decontamination"]) and set(kept["mixing"]) <= set(kept["decontamination"])
    assert sorted(kept["sharding"]) == sorted(kept["mixing"])
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    plain = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
    items = [f" {plain(r['text'])} " for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    holds = lambda i: any(x in f" {plain(texts[i])} " for x in items)
    # Exactly the documents with a benchmark item go.
    assert {i for i in kept["near_duplicates"] if holds(i)} == set(kept["near_duplicates"]) - set(kept["decontamination"])


def test_empty_corpus_and_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs.limit(40).unionByName(docs.limit(3)).unionByName(spark.createDataFrame([(None, None, None, None, None), (5000, "", None, None, 0)], docs.schema))
    for start in (docs.where("false"), odd):
        d = start
        for _, stage in pipeline.STAGES:
            d = stage(spark, d, SF).cache()
            d.count()


def test_texts_that_share_an_id_stay(spark):
    """Rows of one doc_id with unrelated texts are documents of their own; equal rows and near copies are not."""
    words = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    rows = [(1, words(1)), (1, words(2)), (1, words(2)), (2, words(2)), (None, words(1)), (None, words(3)), (None, words(3)), (4, ""), (4, ""), (5, words(4) + " more"), (3, words(4))]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "own", "own") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, node string, row string")
    got = pipeline.near_duplicates(spark, docs, SF)
    assert got.columns == docs.columns
    assert sorted((r["doc_id"] or -1, r["text"]) for r in got.collect()) == sorted([(1, words(1)), (1, words(2)), (-1, words(3)), (4, ""), (4, ""), (3, words(4))])
    mixed = pipeline.mixing(spark, docs.where("doc_id = 1").unionByName(docs.where("doc_id = 5")), SF)
    assert {r["text"] for r in mixed.collect()} == {words(1), words(2), words(4) + " more"}


def test_queries_are_registered():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))


def test_stages_against_brute_force(spark, tmp_path):
    """Each stage from its own input: the posteriors' decision, all pairs of shingle sets, and the mix in DuckDB."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    model = quality.QualityModel(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    want = {r["doc_id"] for r in model.score(docs).where((F.col("p_good") >= 0.5) & (F.col("p_toxic") < 0.5)).select("doc_id").collect()}
    assert {r["doc_id"] for r in pipeline.quality(spark, docs, SF).select("doc_id").collect()} == want

    sets = {}
    for i, r in rows.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sorted(sets):
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    once = {i for i in sets if find(i) == i}
    assert {r["doc_id"] for r in pipeline.near_duplicates(spark, docs, SF).select("doc_id").collect()} == once

    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    taken = db.execute(f"select doc_id, floor(sum(taken) / sum(size) + 0.5) from ({mixing.OP9_SQL}) where size > 0 group by doc_id, source").fetchall()
    times = Counter(r["doc_id"] for r in pipeline.mixing(spark, docs, SF).select("doc_id").collect())
    assert dict(times) == {i: int(n) for i, n in taken if n > 0}


def test_extra_columns_pass_all_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    names = ("_id", "_source", "_times", "_copy", "_row", "_h", "_p", "component_id", "taken", "kept")
    d = docs.select("*", *[F.lit(f"own {n}").alias(n) for n in names])
    for _, stage in pipeline.STAGES[1:]:
        d = stage(spark, d, SF).cache()
        assert all({r[n] for r in d.select(n).distinct().collect()} <= {f"own {n}"} for n in names)
    kept = pipeline.quality(spark, docs.select("*", *[F.lit("own").alias(n) for n in ("_h", "_p", "path_good", "host")]), SF)
    assert kept.columns[-1] == "host" and {r["host"] for r in kept.collect()} == {"own"}
