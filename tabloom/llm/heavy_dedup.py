"""Exact dedup with a split of heavy hitters.

Texts are known by the sha256 of their normalised form, computed where the text is read: only digests and ids move. Misra-Gries
summaries find the digests that can hold more than one in `counters` + 1 of the rows: a task keeps at most `counters` keys, and
merging two summaries keeps as many. Exact counts over all rows then verify those candidates, and the winners (the row that stays,
and the size, of each verified digest: at most `counters` rows) are broadcast, so rows of heavy digests are settled where they
are and never shuffled. All other digests are grouped by an ordinary shuffle, in which no digest is heavy.

Null and edge cases: a null text counts as empty; texts are equal when identical after lower-casing A-Z only. The row with the
largest id stays; of equal texts with the same id (repeated rows) one stays; a null id is below all others. An empty table gives
an empty result; input columns of any name travel in the rows and cannot clash, and those named like the result's are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, columns_without, lower_az, table

#: Keys that a summary holds. Digests in more than one of so many rows plus 1 are found for certain.
COUNTERS = 1024
#: Summaries that one task merges.
FAN_IN = 64


def merge_summaries(keys: np.ndarray, counts: np.ndarray, counters: int) -> tuple[np.ndarray, np.ndarray]:
    """Misra-Gries summary of summaries: counts of equal keys add up; if more than `counters` keys are left, the next largest
    count is taken off all, and keys that reach nothing go. The error of a count is at most rows / (counters + 1)."""
    keys, at = np.unique(keys, return_inverse=True)
    total = np.bincount(at, weights=counts, minlength=len(keys)).astype(np.int64)
    if len(keys) > counters:
        total = total - np.partition(total, -counters - 1)[-counters - 1]
        keys, total = keys[total > 0], total[total > 0]
    return keys, total


def _summarise(counters: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in batches:
            new, n = b.column("key").to_numpy(), b.column("n").to_numpy()
            keys, counts = merge_summaries(np.concatenate([keys, new]), np.concatenate([counts, n]), counters)
        if len(keys):
            yield pa.RecordBatch.from_pydict({"key": keys, "n": counts})

    return run


def heavy_keys(keys: DataFrame, counters: int, scratch: Scratch) -> DataFrame:
    """(key, n): the at most `counters` keys of a table of 64-bit keys that can hold more than rows / (counters + 1) rows. Each
    task sends its summary only, and they are merged in rounds of FAN_IN."""
    parts = keys.rdd.getNumPartitions()
    found = scratch.save(keys.select("key", F.lit(1).cast("long").alias("n")).mapInArrow(_summarise(counters), "key long, n long"), "summaries")
    while parts > 1:
        parts = -(-parts // FAN_IN)
        found = scratch.save(found.repartition(parts).mapInArrow(_summarise(counters), "key long, n long"), f"summaries-{parts}")
    return found


def text_digest(text: str = "text") -> Column:
    """sha256 of the normalised text in UTF-8, as lowercase hex."""
    return F.sha2(lower_az(F.coalesce(F.col(text), F.lit(""))).cast("binary"), 256)


class HeavyDedup:
    """Exact duplicates of a table with an id and a text."""

    def __init__(self, docs: DataFrame, id_column: str = "doc_id", counters: int = COUNTERS):
        self.docs, self.id, self.counters = docs, id_column, counters
        self.scratch = Scratch(docs.sparkSession, "heavy")

    def run(self, whole_rows: bool = False) -> DataFrame:
        """keep_id, group_size, kept and text_sha256 of each row, with its id or, if asked for, all its columns."""
        own = ["keep_id", "group_size", "kept", "text_sha256"]
        rest = F.struct(*columns_without(self.docs, own)) if whole_rows else F.struct(F.col(self.id))
        rows = self.docs.select(rest.alias("row"), F.col(self.id).alias("id"), F.unhex(text_digest()).alias("digest"))
        # The place of a row tells repeated rows apart; it is written once, so a task that is run again reads the same.
        rows = self.scratch.save(rows.withColumn("at", F.monotonically_increasing_id()), "rows")
        n = self.scratch.rows["rows"]
        key = F.xxhash64("digest")
        nominated = F.broadcast(heavy_keys(rows.select(key.alias("key")), self.counters, self.scratch).select("key"))
        size_and_last = (F.count("*").alias("n"), F.max(F.struct("id", "at")).alias("last"))
        winners = rows.withColumn("key", key).join(nominated, "key", "left_semi").groupBy("digest").agg(*size_and_last)
        winners = self.scratch.save(winners.where(F.col("n") > n // (self.counters + 1)), "winners")

        split = rows.join(F.broadcast(winners), "digest", "left")
        settled = split.where(F.col("n").isNotNull())
        light = split.where(F.col("n").isNull()).drop("n", "last")
        groups = light.groupBy("digest").agg(*size_and_last)
        settled = settled.unionByName(light.join(groups, "digest"))
        self.scratch.keep("rows", "winners")
        return settled.select(
            "row.*",
            F.col("last.id").alias("keep_id"),
            F.col("n").cast("long").alias("group_size"),
            (F.col("at") == F.col("last.at")).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )

    def close(self) -> None:
        """Drops the tables that the result reads."""
        self.scratch.drop()


def op11_heavy_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return HeavyDedup(table(spark, sf_dir, "documents").select("doc_id", "text")).run()


OP11_SQL = """
with d as (select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as h from documents)
select doc_id, max(doc_id) over (partition by h) as keep_id, count(*) over (partition by h) as group_size,
  doc_id = max(doc_id) over (partition by h) as kept, h as text_sha256
from d
"""
