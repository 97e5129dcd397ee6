"""Shared plumbing: scratch tables, row identity, connected components, Arrow helpers."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: White space of the word contracts: space and the control characters 9 to 13.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower_az(text: Column) -> Column:
    """A text with A-Z lower-cased and nothing else. A text of single bytes only takes the quick way to the same result."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster. Where none is set a local master gets a temporary one, and any other an error:
    executors on other machines would not see the driver's own folders."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        current = sc._jsc.sc().getCheckpointDir()
        if current.isDefined():
            found = current.get()
        elif re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            found = tempfile.mkdtemp(prefix="tabloom-")
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(found)
    return found


#: Most rows and bytes of an Arrow batch on its way to a Python worker: texts can be long, and every task holds a few.
ARROW_ROWS, ARROW_BYTES = 1024, 16 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batch sizes to those above."""
    for key, most in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", ARROW_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(key, None)
        if not (now or "").rstrip("b").isdigit() or not 0 < int(now.rstrip("b")) <= most:
            spark.conf.set(key, str(most))


class Scratch:
    """Parquet tables in the shared folder: they cut lineage, survive lost executors, and can be dropped early."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        bound_batches(spark)
        self.root = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
        self.rows: dict[str, int] = {}
        self.schemas: dict[str, StructType] = {}

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Writes and rereads a table. Its rows are counted on the way (rows[name]), at least as many as it has."""
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        self.rows[name], self.schemas[name] = int(seen.get["n"]), df.schema
        return self.table(name)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(self.schemas[name]).parquet(self.path(name))

    def keep(self, *names: str) -> None:
        """Drops all tables but those that a result still reads."""
        for name in [n for n in self.rows if n not in names]:
            self.drop(name)
            del self.rows[name]

    def drop(self, name: str = "") -> None:
        jvm, target = self.spark.sparkContext._jvm, self.path(name) if name else self.root
        path = jvm.org.apache.hadoop.fs.Path(target)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Narrow tables up to this many rows (tens of MB) are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 2_000_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS, count: int | None = None) -> DataFrame:
    """A table of a few numbers a row, marked for broadcast if its count, or a bound of it, shows that it is small enough."""
    return F.broadcast(df) if (df.count() if count is None else count) <= rows else df


#: Tables with lists are broadcast up to this many list elements (some tens of MB).
BROADCAST_ELEMENTS = 1_000_000


def small_lists(df: DataFrame, column: str) -> DataFrame:
    """A saved table with a list column, marked for broadcast if all its lists together are short enough."""
    n = df.agg(F.coalesce(F.sum(F.size(column)), F.lit(0))).first()[0]
    return F.broadcast(df) if n <= BROADCAST_ELEMENTS else df


def columns_without(df: DataFrame, names: Iterable[str]) -> list:
    """Columns of df but for those that an operator is about to add: on a clash the operator's column wins."""
    taken = {n.lower() for n in names}
    return [F.col(f"`{c}`") for c in df.columns if c.lower() not in taken]


def batches_of(table_: pa.Table, rows: int = 2048, column: str = "text", max_bytes: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """Slices of at most so many rows, and of about max_bytes of text at most unless a single text is longer."""
    for batch in table_.to_batches(max_chunksize=rows):
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        if sizes.sum() <= max_bytes:
            if batch.num_rows:
                yield batch
            continue
        start = held = 0
        for i, n in enumerate(sizes.tolist()):
            if held and held + n > max_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)


#: Edges that one task joins at a time: two numbers each, so some tens of MB.
LOCAL_EDGES = 1_000_000


def roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges, and the smallest node that each reaches: hooking of roots and pointer jumping."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    i, j = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while len(i):
        a, b = label[i], label[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]
    return nodes, nodes[label]


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a partition as stars; each LOCAL_EDGES edges are joined, then all stars so far."""
    u, v, held = [], [], 0

    def joined() -> None:
        nonlocal u, v, held
        n, r = roots(np.concatenate(u), np.concatenate(v))
        u, v, held = [n[n != r]], [r[n != r]], 0

    for b in batches:
        u.append(b.column("u").to_numpy())
        v.append(b.column("v").to_numpy())
        held += b.num_rows
        if held >= LOCAL_EDGES:
            joined()
    if u:
        joined()
        yield pa.RecordBatch.from_pydict({"u": u[0], "v": v[0]})


def saved_components(edges: DataFrame, scratch: Scratch, name: str, src: str = "src", dst: str = "dst") -> DataFrame:
    """components, saved as a table of scratch; the rounds' own tables are dropped."""
    rounds = Scratch(scratch.spark, "components")
    out = scratch.save(components(edges, rounds, src, dst), name)
    rounds.drop()
    return out


def components(edges: DataFrame, scratch: Scratch, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): smallest node reachable over undirected edges of longs.

    Each partition first joins its own edges to stars. If there are few enough edges for one partition, that is the end.
    Else large-star and small-star contraction alternates: a round is two aggregations over the edges, the number of
    rounds is logarithmic in the longest path, and no node ever gathers its neighbours in one row. Ends when nothing changes.
    """
    e = (
        edges.select(F.col(src).cast("long").alias("u"), F.col(dst).cast("long").alias("v"))
        .where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    e = scratch.save(e, "cc-edges")
    parts = -(-scratch.rows["cc-edges"] // LOCAL_EDGES)
    star = e.repartition(1) if parts <= 1 else e.repartition(parts, "v")
    e = scratch.save(star.mapInArrow(_local, "u long, v long"), "cc-0")
    last, i = None, 0
    while parts > 1:
        i += 1
        # Large star: every larger neighbour of a node goes to the smallest of its neighbourhood.
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: a node and its smaller neighbours go to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        near = large.join(low, "u")
        e2 = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(near.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        e2 = scratch.save(e2, f"cc-{i}")
        mark = tuple(e2.agg(F.count("*"), F.sum("v"), F.bit_xor(F.xxhash64("u", "v"))).first())
        scratch.drop(f"cc-{i - 1}")
        e = e2
        if mark == last:
            break
        last = mark
    scratch.drop("cc-edges")
    # Nodes point at the smallest of their component, which has no edge of its own.
    both = e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")))
    return both.groupBy("node").agg(F.min("component").alias("component"))
