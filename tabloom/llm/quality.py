"""Quality classifier with hierarchical empirical Bayes.

A document's evidence is the logit of a logistic regression, without its base rate, on word and shape features. Words
are hashed; those that tell the classes apart are chosen by a test over all labelled documents. Sites are hosts (the
source) and paths within them (source and language). Labelled counts, gathered by grouped aggregation, give each host a
beta posterior around the global rate, and each path one around its host's, so sparse sites shrink to the level above; the
strengths of shrinkage are estimated from the spread of the sites themselves. A document's posterior log-odds are those
of its path plus its own evidence. Two targets: good (quality = 1) and toxic; a document is kept if good is likely enough and toxic is not.

Only the regression is fitted on a bounded sample (fit_rows labelled documents, chosen by hash); word statistics, site counts
and scores cover all rows.

Null and edge cases: a null text is empty and gets the evidence of no features; null labels are left out of their target;
a null source or language is a site of its own; unlabelled sites get the posterior of the level above; without any
labels of a target its rate is a half and the evidence 0; repeated rows are scored each on its own; extra columns pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, batches_of, columns_without, small, table
from .shingles import word_hashes

BUCKETS = 1 << 18
TARGETS = ("good", "toxic")
_LETTERS = bytes(b if 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_CLASS = np.zeros(256, np.uint8)  # 1 upper, 2 lower or beyond ASCII, 3 digit, 4 space, 5 bar, 6 other
for _b in range(256):
    _CLASS[_b] = 1 if 65 <= _b <= 90 else 2 if 97 <= _b <= 122 or _b >= 128 else 3 if 48 <= _b <= 57 else 4 if _b in (32, 9, 10, 11, 12, 13) else 5 if _b == 124 else 6
SHAPES = ("log_words", "upper", "digit", "bar", "symbol", "repeat", "distinct", "letters_per_word", "empty")


def word_buckets(texts: list[bytes | None]) -> list[np.ndarray]:
    """Buckets of the letter words of each text."""
    return [(w & np.uint64(BUCKETS - 1)).astype(np.int64) for w in word_hashes([(t or b"").translate(_LETTERS) for t in texts])]


def shapes(texts: list[bytes | None], words: list[np.ndarray]) -> np.ndarray:
    """Shape features of each text."""
    out = np.zeros((len(texts), len(SHAPES)))
    for i, (t, w) in enumerate(zip(texts, words, strict=True)):
        n = len(t or b"")
        if not n or not len(w):
            out[i, -1] = 1
            continue
        c = np.bincount(_CLASS[np.frombuffer(t, np.uint8)], minlength=7)
        letters = max(1, c[1] + c[2])
        out[i] = (
            np.log1p(len(w)), c[1] / letters, c[3] / n, c[5] / len(w), c[6] / len(w), (w[1:] == w[:-1]).mean() if len(w) > 1 else 0.0,
            len(np.unique(w)) / len(w) * np.log1p(len(w)), letters / len(w), 0.0,
        )
    return out


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents that hold each bucket, by target and class; bucket -1 counts documents."""
    counts = np.zeros((4, BUCKETS), np.int64)
    total = np.zeros(4, np.int64)
    for big in batches:
        for batch in batches_of(pa.Table.from_batches([big]), 512):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for w, good, toxic in zip(word_buckets(texts), batch.column("good").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                u = np.unique(w)
                for t, y in enumerate((good, toxic)):
                    if y is not None:
                        counts[2 * t + y, u] += 1
                        total[2 * t + y] += 1
    some = np.flatnonzero(counts.any(axis=0))
    all_ = np.concatenate([[-1], some])
    c = np.concatenate([total[:, None], counts[:, some]], axis=1)
    yield pa.RecordBatch.from_pydict({"bucket": all_} | {f"n{k}": c[k] for k in range(4)})


@dataclass
class Evidence:
    """The document classifier of one target: chosen buckets and standardized linear weights."""

    buckets: np.ndarray
    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    bias: float

    def logits(self, words: list[np.ndarray], shape: np.ndarray) -> np.ndarray:
        x = np.concatenate([presence(words, self.buckets), shape], axis=1)
        return ((x - self.mean) / self.scale) @ self.weights + self.bias


def presence(words: list[np.ndarray], buckets: np.ndarray) -> np.ndarray:
    """Whether each chosen bucket occurs, one row per text."""
    column = np.full(BUCKETS, -1, np.int32)
    column[buckets] = np.arange(len(buckets))
    out = np.zeros((len(words), len(buckets)))
    for i, w in enumerate(words):
        c = column[w]
        out[i, c[c >= 0]] = 1
    return out


def choose_buckets(counts: DataFrame, n0: str, n1: str, t0: int, t1: int, most: int, least_z: float) -> np.ndarray:
    """Buckets whose document rates differ most between the classes, by a two-sample test."""
    p = (F.col(n0) + F.col(n1)) / max(1, t0 + t1)
    z = (F.col(n1) / max(1, t1) - F.col(n0) / max(1, t0)) / F.sqrt(F.greatest(p * (1 - p), F.lit(1e-12)) * (1 / max(1, t1) + 1 / max(1, t0)))
    top = counts.where("bucket >= 0").select("bucket", F.abs(z).alias("z")).where(F.col("z") >= least_z).orderBy(F.desc("z"), "bucket").limit(most)
    return np.array([r["bucket"] for r in top.collect()], np.int64)


@dataclass
class Design:
    """Rows of a regression, presence of the chosen buckets as bits; only so many are unpacked at a time."""

    bits: np.ndarray
    width: int
    shape: np.ndarray

    def blocks(self, rows: int = 1024) -> Iterator[tuple[slice, np.ndarray]]:
        for at in range(0, len(self.bits), rows):
            part = slice(at, at + rows)
            yield part, np.concatenate([np.unpackbits(self.bits[part], axis=1, count=self.width), self.shape[part]], axis=1, dtype=np.float64)


def fit(x: Design, y: np.ndarray, ridge: float = 1.0, steps: int = 25) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Ridge logistic regression by Newton steps. The bias is for balanced classes: base rates come from the sites."""
    n = len(y)
    mean = sum(b.sum(axis=0) for _, b in x.blocks()) / n
    scale = np.sqrt(sum(np.square(b - mean).sum(axis=0) for _, b in x.blocks()) / n) + 1e-9
    k = len(mean) + 1
    w = np.zeros(k)
    each = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * n
    penalty = np.full(k, ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        g, h = -penalty * w, np.diag(penalty)
        for part, b in x.blocks():
            z = np.concatenate([(b - mean) / scale, np.ones((len(b), 1))], axis=1)
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            g += z.T @ (each[part] * (y[part] - p))
            h += (z * (each[part] * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z
        step = np.linalg.solve(h, g)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], mean, scale, float(w[-1])


def _features(buckets: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in batches_of(pa.Table.from_batches([big]), 512):
                texts = batch.column("text").cast(pa.binary()).to_pylist()
                words = word_buckets(texts)
                bits = {f"x{t}": pa.array([r.tobytes() for r in np.packbits(presence(words, b).astype(bool), axis=1)], pa.binary()) for t, b in enumerate(buckets)}
                shape = pa.array([r.tobytes() for r in shapes(texts, words).astype("<f4")], pa.binary())
                yield pa.RecordBatch.from_pydict({"draw": batch.column("draw"), "good": batch.column("good"), "toxic": batch.column("toxic")} | bits | {"shape": shape})

    return run


def _matrix(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    data = b"".join(column.to_pylist())
    return np.frombuffer(bytearray(data), kind).reshape(len(column), len(data) // np.dtype(kind).itemsize // len(column))


class QualityModel:
    def __init__(self, docs: DataFrame, labels: DataFrame, fit_rows: int = 10_000, features: int = 200, least_z: float = 5.0, host: str = "source", path: str = "lang"):
        self.host, self.path = host, path
        self.spark = docs.sparkSession
        self.scratch = Scratch(self.spark, "quality")
        marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("good"), F.max("toxic").cast("int").alias("toxic"))
        marks = self.scratch.save(marks.where("good is not null or toxic is not null"), "labels")
        self.n_labels = self.scratch.rows["labels"]
        self.labelled = docs.select("doc_id", "text", F.col(host).alias("host"), F.col(path).alias("path")).join(small(marks, count=self.n_labels), "doc_id")
        counts = self.labelled.select("text", "good", "toxic").mapInArrow(_word_counts, "bucket long, n0 long, n1 long, n2 long, n3 long")
        counts = self.scratch.save(counts.groupBy("bucket").agg(*[F.sum(f"n{k}").alias(f"n{k}") for k in range(4)]), "word-counts")
        total = (counts.where("bucket < 0").first() or [0] * 5)[1:]
        chosen = [choose_buckets(counts, f"n{2 * t}", f"n{2 * t + 1}", total[2 * t], total[2 * t + 1], features, least_z) for t in range(2)]
        share = min(1.0, fit_rows / max(1, self.n_labels))
        # About fit_rows rows by hash, and of those the first by the same hash: reruns fit the same rows in the same order.
        draw = F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1 << 40))
        picked = self.labelled.withColumn("draw", draw).where(F.col("draw") < int(share * (1 << 40))).select("draw", "text", "good", "toxic")
        x = picked.mapInArrow(_features(chosen), "draw long, good int, toxic int, x0 binary, x1 binary, shape binary").orderBy("draw").limit(fit_rows).toArrow()
        self.evidence: list[Evidence | None] = []
        for t, target in enumerate(TARGETS):
            d = x.select([target, f"x{t}", "shape"]).filter(pc.is_valid(x.column(target)))
            y = d.column(target).to_numpy().astype(np.float64)
            if len(d) < 10 or y.min() == y.max():
                self.evidence.append(None)
                continue
            w, mean, scale, bias = fit(Design(_matrix(d.column(f"x{t}"), "u1"), len(chosen[t]), _matrix(d.column("shape"), "<f4")), y)
            self.evidence.append(Evidence(chosen[t], w, mean, scale, bias))

    def sites(self) -> DataFrame:
        """host, path and, for each target, the path's posterior rate; hosts without a path row have theirs under path_known = false."""
        if "sites" in self.scratch.rows:
            return self.scratch.table("sites")
        s, self.rates = None, {}
        for t in TARGETS:
            y = self.labelled.where(F.col(t).isNotNull())
            paths = self.scratch.save(y.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(t).alias("s")), f"paths-{t}")
            hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
            a = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.count("*").alias("h"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("ss")).first()
            n, rate = float(a["n"] or 0), (float(a["s"]) + 0.5) / (float(a["n"]) + 1) if a["n"] else 0.5
            self.rates[t] = rate
            # Spread of the hosts' rates about the global one, by moments; its strength in pseudo-counts.
            k1 = _strength(n, float(a["h"] or 0), float(a["nn"] or 0), float(a["ss"] or 0) - 2 * rate * float(a["s"] or 0) + rate * rate * n, rate)
            hosts = self.scratch.save(hosts.withColumn("hp", (F.col("s") + k1 * rate) / (F.col("n") + k1)).select("host", "hp"), f"hosts-{t}")
            both = paths.join(small(hosts.withColumnRenamed("host", "h"), count=self.scratch.rows[f"hosts-{t}"]), F.col("host").eqNullSafe(F.col("h"))).drop("h")
            b = both.agg(F.count("*").alias("h"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - F.col("hp"), 2)).alias("q")).first()
            k2 = _strength(n, float(b["h"] or 0), float(b["nn"] or 0), float(b["q"] or 0), rate)
            level2 = both.select("host", "path", ((F.col("s") + k2 * F.col("hp")) / (F.col("n") + k2)).alias(f"path_{t}"), F.col("hp").alias(f"host_{t}"))
            s = level2 if s is None else s.withColumnsRenamed({"host": "h2", "path": "p2"}).join(level2, F.col("h2").eqNullSafe(F.col("host")) & F.col("p2").eqNullSafe(F.col("path")), "full").select(F.coalesce("host", "h2").alias("host"), F.coalesce("path", "p2").alias("path"), f"path_{TARGETS[0]}", f"host_{TARGETS[0]}", f"path_{t}", f"host_{t}")
        return self.scratch.save(s, "sites")

    def score(self, docs: DataFrame, least_good: float = 0.5, most_toxic: float = 0.5) -> DataFrame:
        """docs with evidence_good, evidence_toxic, p_good, p_toxic and kept."""
        own = ["evidence_good", "evidence_toxic", "p_good", "p_toxic", "kept"]
        base = docs.select(*columns_without(docs, own))
        scored = base.mapInArrow(_score(self.evidence), _schema(base))
        sites = self.sites()
        hosts = self.scratch.save(sites.groupBy("host").agg(*[F.max(f"host_{t}").alias(f"h_{t}") for t in TARGETS]), "host-rates")
        sites = sites.select(F.col("host").alias("_h"), F.col("path").alias("_p"), *[f"path_{t}" for t in TARGETS])
        hosts = hosts.withColumnRenamed("host", "_g")
        # The input's columns travel in a struct, so none of them can clash with the names used here.
        d = scored.select(F.struct(*[F.col(f"`{c}`") for c in base.columns]).alias("_row"), F.col(self.host).alias("_host"), F.col(self.path).alias("_path"), *[f"evidence_{t}" for t in TARGETS])
        d = d.join(small(sites, count=self.scratch.rows["sites"]), F.col("_host").eqNullSafe(F.col("_h")) & F.col("_path").eqNullSafe(F.col("_p")), "left")
        d = d.join(small(hosts, count=self.scratch.rows["host-rates"]), F.col("_host").eqNullSafe(F.col("_g")), "left")
        for t in TARGETS:
            prior = F.coalesce(F.col(f"path_{t}"), F.col(f"h_{t}"), F.lit(self.rates[t]))
            d = d.withColumn(f"p_{t}", 1 / (1 + F.exp(-(F.log(prior / (1 - prior)) + F.col(f"evidence_{t}")))))
        d = d.withColumn("kept", (F.col("p_good") >= least_good) & (F.col("p_toxic") < most_toxic))
        self.scratch.keep("labels", "sites", "host-rates")
        return d.select("_row.*", *own)


def _schema(df: DataFrame):
    from pyspark.sql.types import DoubleType, StructField, StructType

    return StructType([*df.schema.fields, *[StructField(f"evidence_{t}", DoubleType()) for t in TARGETS]])


def _strength(n: float, sites: float, nn: float, spread: float, rate: float) -> float:
    """Pseudo-counts of a level's prior: binomial variance over the variance between sites, from weighted moments."""
    if n <= 0 or sites < 2:
        return 10.0
    between = (spread - (sites - 1) * rate * (1 - rate)) / max(1e-9, n - nn / n)
    return float(np.clip(rate * (1 - rate) / max(between, 1e-6) - 1, 1.0, 1e5))


def _score(evidence: list[Evidence | None]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in batches_of(pa.Table.from_batches([big]), 512):
                texts = batch.column("text").cast(pa.binary()).to_pylist()
                words = word_buckets(texts)
                shape = shapes(texts, words)
                logits = [e.logits(words, shape) if e else np.zeros(len(texts)) for e in evidence]
                yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(x, pa.float64()) for x in logits]], names=[*batch.schema.names, "evidence_good", "evidence_toxic"])

    return run


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the classifier keeps, with evidence and posteriors."""
    docs = table(spark, sf_dir, "documents")
    model = QualityModel(docs, table(spark, sf_dir, "labels"))
    return model.score(docs.select("doc_id", "text", "source", "lang")).where("kept").drop("text")
