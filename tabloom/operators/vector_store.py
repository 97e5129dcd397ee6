"""A store of tenants' vectors, and an index that opens few of its parts and stays exact.

The store keeps rows by (org, id) in a fixed number of buckets. A put writes a new version of the buckets that it touches, whole, and then a
list of where each bucket now is; the list with the highest number is the store. Versions are counted, not timed, so two puts
at one moment have an order, a reader sees a put wholly or not at all, and a second writer of the same version fails. There is no
read without an organisation.

The index assigns each unit vector to the nearest of some pivots and keeps the radius of each pivot's cell. A query opens the
nearest cells until it has k vectors; the k-th distance then rules out, by the triangle inequality, all cells whose nearest
possible point is farther.

Null and edge cases: a put with two rows of one (org, id) is refused, as are null keys; a null or zero vector is stored and never
found; an empty store has no rows; fewer than k vectors give all of them; scores are cosines in doubles, ties by id.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.operators.retrieval import cosine_top_k, same_provider
from tabloom.operators.usage import tenant_scope

KEY = ("org", "id")


class VectorStore:
    """Rows with org, id, embedding, provider and whatever else all rows have."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _exists(self, path: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def version(self) -> int:
        """Number of the newest list that was written to its end; 0 for an empty store."""
        n = 0
        while self._exists(f"{self.path}/lists/{n + 1}/_SUCCESS"):
            n += 1
        return n

    def _places(self, version: int) -> dict[int, int]:
        """Version that holds each bucket: at most `buckets` rows."""
        return {r["bucket"]: r["version"] for r in self.spark.read.parquet(f"{self.path}/lists/{version}").collect()} if version else {}

    def _read(self, places: dict[int, int]) -> DataFrame | None:
        paths = [f"{self.path}/rows/{v}/bucket={b}" for b, v in sorted(places.items())]
        return self.spark.read.parquet(*paths) if paths else None

    def _bucket(self):
        return F.pmod(F.xxhash64(*KEY), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, now: int, places: dict[int, int], touched: set[int]) -> None:
        """Rows of the touched buckets as version now + 1, then the list."""
        v = now + 1
        rows.withColumn("bucket", self._bucket()).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/rows/{v}")
        found = {r["bucket"] for r in self.spark.read.parquet(f"{self.path}/rows/{v}").select("bucket").distinct().collect()} if rows.limit(1).count() else set()
        kept = {b: p for b, p in places.items() if b not in touched} | dict.fromkeys(found, v)
        self.spark.createDataFrame(sorted(kept.items()), "bucket int, version int").coalesce(1).write.parquet(f"{self.path}/lists/{v}")

    def put(self, rows: DataFrame) -> None:
        """Rows in place of those with the same (org, id)."""
        if rows.where("org is null or id is null").limit(1).count():
            raise ValueError("a vector needs an organisation and an id")
        if rows.groupBy(*KEY).count().where("count > 1").limit(1).count():
            raise ValueError("a put has one row for each organisation and id")
        now = self.version()
        places = self._places(now)
        touched = {r[0] for r in rows.select(self._bucket()).distinct().collect()}
        old = self._read({b: v for b, v in places.items() if b in touched})
        both = rows if old is None else old.join(rows.select(*KEY), list(KEY), "left_anti").unionByName(rows, allowMissingColumns=True)
        self._write(both, now, places, touched)

    def remove(self, keys: DataFrame) -> None:
        """Rows of these (org, id) go."""
        now = self.version()
        places = self._places(now)
        touched = {r[0] for r in keys.select(self._bucket()).distinct().collect()} & set(places)
        old = self._read({b: places[b] for b in touched})
        if old is not None:
            self._write(old.join(keys.select(*KEY), list(KEY), "left_anti"), now, places, touched)

    def rows(self, org: str) -> DataFrame:
        """One organisation's rows."""
        found = self._read(self._places(self.version()))
        if found is None:
            return self.spark.createDataFrame([], "org string, id string, embedding array<double>, provider string")
        return tenant_scope(found, org, "org")

    def nearest(self, org: str, query: Sequence[float], provider: str, k: int) -> DataFrame:
        """id, score of the organisation's k nearest; all its vectors have to come from the query's provider."""
        return cosine_top_k(same_provider(self.rows(org), provider), list(query), k, "id", "embedding")


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=-1, keepdims=True))


class PivotIndex:
    """Cells of vectors around pivots, stored as one folder each."""

    #: Distances of doubles are this near to the true ones.
    SLACK = 1e-7

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        #: Cells that the last search opened.
        self.opened: list[int] = []

    def build(self, vectors: DataFrame, ident: str = "id", vector: str = "embedding", pivots: int = 64) -> PivotIndex:
        """All vectors but null and zero ones. The pivots are the first by hash: at most `pivots` rows come to the driver."""
        v = vectors.select(F.col(ident).alias("id"), F.col(vector).cast("array<double>").alias("embedding"))
        v = v.where(F.exists("embedding", lambda x: x != 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x)))
        chosen = [r["embedding"] for r in v.orderBy(F.xxhash64("embedding"), "id").limit(pivots).collect()]
        at = _unit(np.array(chosen, np.float64)) if chosen else np.zeros((0, 1))

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    x = _unit(b.column("embedding").flatten().to_numpy().reshape(b.num_rows, -1))
                    d = np.sqrt(np.maximum(0, 2 - 2 * x @ at.T))
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(d.argmin(axis=1).astype(np.int32)), pa.array(d.min(axis=1))], [*b.schema.names, "cell", "dist"])

        kind = v.schema["id"].dataType.simpleString()
        if chosen:
            # A cell may hold any share of the rows, so its rows are spread over several files.
            placed = v.mapInArrow(place, f"id {kind}, embedding array<double>, cell int, dist double")
            placed.write.partitionBy("cell").parquet(f"{self.path}/rows")
            stored = self.spark.read.parquet(f"{self.path}/rows")
            radii = stored.groupBy("cell").agg(F.max("dist").alias("radius"), F.count("*").alias("n"))
            known = self.spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(at)], "cell int, pivot array<double>")
            radii.join(F.broadcast(known), "cell").coalesce(1).write.parquet(f"{self.path}/cells")
        return self

    def search(self, query: Sequence[float], k: int) -> DataFrame:
        """id, score of the k nearest by cosine, the same as by a scan of all vectors."""
        cells = self.spark.read.parquet(f"{self.path}/cells").orderBy("cell").collect()
        q = _unit(np.array(query, np.float64))
        away = np.sqrt(np.maximum(0, 2 - 2 * np.array([r["pivot"] for r in cells]) @ q))
        least = np.maximum(0, away - np.array([r["radius"] for r in cells]))
        found, first = 0, []
        for i in np.argsort(away, kind="stable"):
            first.append(i)
            found += cells[i]["n"]
            if found >= k:
                break
        open_ = lambda which: self.spark.read.parquet(*[f"{self.path}/rows/cell={cells[i]['cell']}" for i in which])
        best = cosine_top_k(open_(first), list(query), k, "id", "embedding").agg(F.min("score"), F.count("*")).first()
        reach = np.sqrt(max(0.0, 2 - 2 * best[0])) if best[1] >= k else 2.0
        near = np.flatnonzero(least <= reach + self.SLACK)
        self.opened = sorted({cells[i]["cell"] for i in [*first, *near]})
        return cosine_top_k(open_(sorted({*first, *near.tolist()})), list(query), k, "id", "embedding")
