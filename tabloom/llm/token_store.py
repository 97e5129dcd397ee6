"""Token ids on disk as directly addressable codes.

An id is split into 8-bit chunks. Level 0 holds the lowest chunk of every id, level k the k-th chunk of those ids that
have one; a bitmap per level marks the ids that continue, and a rank directory (ones before each 512 bits) gives the
place of an id's next chunk. So any id is read from its position with one look-up a level, without decoding others.

A store is a folder with two Parquet tables. `segments` has one row per run of whole documents: shard, segment, n_docs,
n_ids, base (ids before it in its shard), doc_ids, lengths (a code) and ids (a code). `shards` has the ids before each
shard. Shards are ranges of doc_id in order, so the store as a whole is in ascending doc_id order.

Null and edge cases: a null text is empty and yields the end id alone; null doc_ids come first; rows with one doc_id
are kept as separate documents, ordered by text; an empty table gives an empty store; other columns are not read.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, batches_of, table

MAGIC = b"DAC1"
RANK_BITS = 512
#: A segment ends with the document that brings it to so many ids.
SEGMENT_IDS = 1 << 15
#: Words whose ids a worker remembers.
CACHE_WORDS = 600_000


def encode_codes(values: np.ndarray) -> bytes:
    """Directly addressable codes of non-negative integers."""
    levels, v = [], np.asarray(values, dtype=np.uint64)
    while True:
        rest = v >> np.uint64(8)
        more = rest > 0
        bits = np.packbits(more, bitorder="little")
        padded = np.zeros(-(-len(more) // RANK_BITS) * RANK_BITS, dtype=bool)
        padded[: len(more)] = more
        ones = padded.reshape(-1, RANK_BITS).sum(axis=1)
        ranks = np.concatenate([[0], np.cumsum(ones)[:-1]]).astype("<u4") if len(ones) else np.zeros(0, "<u4")
        levels.append(struct.pack("<QI", len(v), len(ranks)) + (v & np.uint64(255)).astype(np.uint8).tobytes() + bits.tobytes() + ranks.tobytes())
        if not more.any():
            break
        v = rest[more]
    return MAGIC + struct.pack("<B", len(levels)) + b"".join(levels)


class Codes:
    """Reader of encode_codes' bytes: one value by position, or all of them."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a directly addressable code")
        self.levels, at = [], 5
        for _ in range(data[4]):
            n, n_ranks = struct.unpack_from("<QI", data, at)
            at += 12
            chunks = np.frombuffer(data, np.uint8, n, at)
            at += n
            bits = np.frombuffer(data, np.uint8, (n + 7) // 8, at)
            at += (n + 7) // 8
            ranks = np.frombuffer(data, "<u4", n_ranks, at)
            at += 4 * n_ranks
            self.levels.append((chunks, bits, ranks))

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < len(self):
            raise IndexError(i)
        value = 0
        for k, (chunks, bits, ranks) in enumerate(self.levels):
            value |= int(chunks[i]) << (8 * k)
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // RANK_BITS
            ones = np.unpackbits(bits[block * RANK_BITS // 8 : (i >> 3) + 1], bitorder="little")
            i = int(ranks[block]) + int(ones[: i - block * RANK_BITS].sum())
        return value

    def all(self) -> np.ndarray:
        v = np.zeros(0, np.uint64)
        for chunks, bits, _ in reversed(self.levels):
            whole = chunks.astype(np.uint64)
            if len(v):
                whole[np.unpackbits(bits, count=len(chunks), bitorder="little").astype(bool)] |= v << np.uint64(8)
            v = whole
        return v


class WordEncoder:
    """Ids of a text by a tokenizer whose words never cross white space (its normalizer folds runs of white space and
    letter case, its pre-tokenizer drops the rest and parts letters from punctuation), so a word's ids are computed
    once, and a word of letters with closing punctuation is the two. Texts with the opening of a special token are given
    to the tokenizer whole. Two generations of words are kept: frequent ones move to the young one when met again."""

    CLOSING = b".,;:!?|*#$%&()"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each has. The distinct words of the texts are looked up once."""
        texts = pc.fill_null(texts, "")
        special = np.flatnonzero(pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False))
        apart = {int(i): np.array(self.tokenizer.encode(texts[int(i)].as_py(), add_special_tokens=False).ids, "<u4") for i in special}
        if apart:
            texts = pc.if_else(pc.match_substring(texts, "<|"), "", texts)
        words = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        coded = words.flatten().dictionary_encode()
        distinct = coded.dictionary.cast(pa.binary()).to_pylist()
        if len(self.young) > CACHE_WORDS:
            self.young, self.old = {}, self.young
        self.young[b""] = b""
        self._learn([w for w in distinct if w not in self.young])
        ids = list(map(self.young.__getitem__, distinct))
        n = np.fromiter(map(len, ids), np.int64, len(ids)) >> 2
        flat, at = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(n) - n
        word = coded.indices.to_numpy()
        each = n[word]
        upto = np.concatenate([[0], np.cumsum(each)])
        out = flat[np.repeat(at[word] - upto[:-1], each) + np.arange(upto[-1])]
        bounds = upto[words.offsets.to_numpy() - words.offsets[0].as_py()]
        counts = np.diff(bounds)
        for i, own in sorted(apart.items(), reverse=True):
            out = np.insert(out, bounds[i], own)
            counts[i] = len(own)
        return out, counts

    def _learn(self, new: list[bytes]) -> None:
        young, old = self.young, self.old
        split: list[tuple[bytes, bytes, bytes]] = []
        pieces: set[bytes] = set()
        for w in new:
            if (known := old.get(w)) is not None:
                young[w] = known
                continue
            core = w.rstrip(self.CLOSING)
            if 0 < len(core) < len(w) and core.decode().lower().isalpha():
                split.append((w, core, w[len(core) :]))
                pieces.add(core)
                pieces.add(w[len(core) :])
            else:
                pieces.add(w)
        pieces.difference_update(young.keys())
        fresh = []
        for w in pieces:
            if (known := old.get(w)) is not None:
                young[w] = known
            else:
                fresh.append(w)
        for w, e in zip(fresh, self.tokenizer.encode_batch_fast([w.decode() for w in fresh], add_special_tokens=False), strict=True):
            young[w] = np.array(e.ids, "<u4").tobytes()
        for w, core, tail in split:
            young[w] = young[core] + young[tail]


SEGMENTS = "shard int, segment int, n_docs long, n_ids long, base long, doc_ids array<long>, lengths binary, ids binary"
_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder, kept from task to task with the words that it knows. (A worker imports this function by
    name, so it finds the worker's own _ENCODERS; a closure would carry an empty copy.)"""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def _segments(tokenizer: str, end_id: int):
    schema = pa.schema([("shard", pa.int32()), ("segment", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("base", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.binary()), ("ids", pa.binary())])
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        docs: list = []
        parts: list[np.ndarray] = []
        n = base = segment = shard = 0

        def flush() -> pa.RecordBatch:
            lengths = np.array([len(p) for p in parts], np.int64)
            return pa.RecordBatch.from_pydict({"shard": [shard], "segment": [segment], "n_docs": [len(docs)], "n_ids": [n], "base": [base], "doc_ids": [docs], "lengths": [encode_codes(lengths)], "ids": [encode_codes(np.concatenate(parts))]}, schema=schema)

        for big in batches:
            for batch in batches_of(pa.Table.from_batches([big])):
                shard = batch.column("shard")[0].as_py()
                ids, counts = encode(batch.column("text"))
                ends = np.cumsum(counts)
                ids = np.insert(ids, ends, end_id)
                ends += np.arange(1, len(counts) + 1)
                start = 0
                for doc, stop in zip(batch.column("doc_id").to_pylist(), ends.tolist(), strict=True):
                    docs.append(doc)
                    parts.append(ids[start:stop])
                    n += stop - start
                    start = stop
                    if n >= SEGMENT_IDS:
                        yield flush()
                        base, segment, n, docs, parts = base + n, segment + 1, 0, [], []
        if docs:
            yield flush()

    return run


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1) -> None:
    """Tokenize doc_id and text of docs into a store at path."""
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.withColumn("shard", F.spark_partition_id()).mapInArrow(_segments(tokenizer, end_id), SEGMENTS).write.mode("overwrite").parquet(f"{path}/segments")
    spark = docs.sparkSession
    totals = spark.read.schema(SEGMENTS).parquet(f"{path}/segments").groupBy("shard").agg(F.sum("n_ids").alias("n_ids"), F.sum("n_docs").alias("n_docs"))
    before = W.partitionBy(F.lit(0)).orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    totals.select("shard", "n_ids", "n_docs", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("first_id")).coalesce(1).write.mode("overwrite").parquet(f"{path}/shards")


def _documents(with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda c: batch.column(c)[row].as_py()  # noqa: B023, E731
                lengths = Codes(get("lengths")).all().astype(np.int64)
                ids = Codes(get("ids")).all().astype("<u4")
                ends = np.cumsum(lengths)
                pieces = [ids[e - n : e] for e, n in zip(ends, lengths, strict=True)]
                out = {
                    "doc_id": pa.array(get("doc_ids"), pa.int64()),
                    "start": pa.array(get("first_id") + get("base") + ends - lengths, pa.int64()),
                    "n_tokens": pa.array(lengths, pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(p.tobytes()) for p in pieces], pa.int64()),
                }
                if with_ids:
                    out["ids"] = pa.array([p.astype(np.int32) for p in pieces], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(out)

    return run


def _read(spark: SparkSession, path: str) -> DataFrame:
    shards = spark.read.parquet(f"{path}/shards").select("shard", "first_id")
    return spark.read.schema(SEGMENTS).parquet(f"{path}/segments").join(shards, "shard")


def read_store(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of each document of a store."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return _read(spark, path).mapInArrow(_documents(with_ids), schema)


def read_tokens(spark: SparkSession, path: str, positions: list[int]) -> dict[int, int]:
    """Ids at given positions of the whole store, by random access: only the segments that hold them are read, and
    within a segment only the chunks of those ids. The positions asked for are a stated list."""
    first = F.col("first_id") + F.col("base")
    asked = spark.createDataFrame([(int(p),) for p in positions], "at long")
    places = _read(spark, path).select("shard", "segment", first.alias("first"), "n_ids")
    held = places.join(F.broadcast(asked), (F.col("at") >= F.col("first")) & (F.col("at") < F.col("first") + F.col("n_ids"))).groupBy("shard", "segment", "first").agg(F.collect_list("at").alias("at"))
    # The few segments that hold them are named, so that the scan skips the pages of the others; ids stay on the executors.
    named = held.collect()
    if not named:
        return {}
    places = spark.createDataFrame([tuple(r) for r in named], "shard int, segment int, first long, at array<long>")
    some = _read(spark, path).where(F.col("shard").isin(*{r["shard"] for r in named}) & F.col("segment").isin(*{r["segment"] for r in named}))
    rows = some.join(F.broadcast(places), ["shard", "segment"]).select("first", "at", "ids").mapInArrow(_pick, "at long, id long")
    return {r["at"]: r["id"] for r in rows.collect()}


def _pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, at, ids in zip(*[batch.column(c).to_pylist() for c in ("first", "at", "ids")], strict=True):
            codes = Codes(ids)
            yield pa.RecordBatch.from_pydict({"at": pa.array(at, pa.int64()), "id": pa.array([codes[p - first] for p in at], pa.int64())})


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = Scratch(spark, "tokens").path("store")
    write_store(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return read_store(spark, path)
