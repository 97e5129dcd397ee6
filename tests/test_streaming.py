import time

from pyspark.sql.streaming.query import StreamingQuery

from tabloom.plans import catalogue
from tabloom.streaming import operators as s


def run(spark, df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def test_token_bucket_stream(spark, tmp_path):
    spark.createDataFrame([("a", 0.0), ("a", 0.0), ("a", 0.0), ("a", 1.0), ("b", 0.0)], "k string, seconds double").coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema("k string, seconds double").parquet(str(tmp_path / "in"))
    q = s.rate_limited(stream, "k", 2.0, 1.0).writeStream.format("memory").queryName("buckets").outputMode("append").start()
    # State with a time to live keeps the query busy with empty batches, so it is watched instead of drained.
    for _ in range(80):
        out = spark.table("buckets").collect()
        if len(out) >= 5 or q.exception():
            break
        time.sleep(0.5)
    q.stop()
    assert sorted((r["key"], r["seconds"], r["allowed"]) for r in out) == [("a", 0.0, False), ("a", 0.0, True), ("a", 0.0, True), ("a", 1.0, True), ("b", 0.0, True)]


def test_first_seen(spark, tmp_path):
    spark.sql("SELECT * FROM VALUES ('a', timestamp'2026-01-01 00:00:00'), ('a', timestamp'2026-01-01 00:01:00'), ('b', timestamp'2026-01-01 00:00:00') t(k, ts)").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, ts timestamp").parquet(str(tmp_path / "in"))
    assert sorted(r["k"] for r in run(spark, s.first_seen(stream, ["k"], "ts"), "firsts").collect()) == ["a", "b"]
    counts = run(spark, s.tumbling_counts(spark.readStream.schema("k string, ts timestamp").parquet(str(tmp_path / "in")), "ts", "k"), "counts")
    assert counts.count() in (0, 1, 2)  # a window is given out once the watermark has passed it


def test_daily_counts_wait_for_the_whole_stream(spark, monkeypatch):
    wait = StreamingQuery.awaitTermination
    # A stream that outlasts any limit: a wait with one ends before the stream does.
    monkeypatch.setattr(StreamingQuery, "awaitTermination", lambda self, timeout=None: wait(self) if timeout is None else False)
    sf = "/root/testdata/sf0.001"
    got = catalogue.QUERIES["stream_daily_counts"](spark, sf)
    assert sum(r["n"] for r in got.collect()) == spark.read.parquet(f"{sf}/events.parquet").count()
