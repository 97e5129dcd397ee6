"""Removal of long repeated byte strings by distributed prefix doubling over sampled suffixes.

A 400-byte string repeats exactly if its whole content does, so suffixes are compared by rank: the rank of a longer prefix
is the pair of the rank so far and the rank of the next bytes. Ranking every byte position would sort many times the
corpus, so suffixes are sampled by content: of each 400-byte window the suffix with the smallest rank of its first
100 bytes (leftmost on ties) stands for the window. Equal windows have it at the same place, so nothing is lost.

1. Every sampled suffix (an anchor) has rank 0 from 100 bytes. Spark brings equal ranks together; unique ones are done.
2. Reranking doubles the prefix at growing offsets, to 200 and 400 bytes, and the same to the left, by pairs of
   ranks. An anchor unique at some length keeps only those of its windows that do not need that length; an anchor
   whose lengths to the left and right cannot add up to 400 is done.
3. What is left is settled exactly. An anchor whose whole neighbourhood has a twin has only repeated windows. Of the
   others, a block of windows repeats if all the bytes under it have a twin, and cannot if the bytes common to its windows
   have none; only the windows of the blocks in between are counted one by one, by 128-bit fingerprints.

Repeated windows are joined to runs per document, and their bytes are left out.

Null and edge cases: a null text is empty; texts under 400 bytes have no windows; overlaps within a document count;
repeated rows are documents of their own, so each finds the other; rows are told apart by doc_id and a hash of the text, so
repeated or null doc_ids are fine; extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, batches_of, small, small_lists, table
from .shingles import Powers, mix

U = np.uint64
#: Positions fit in these low bits of a packed key; longer texts are cut into overlapping buffers.
_BITS = 21
_MASK = U((1 << _BITS) - 1)
BUFFER = 1 << 20
#: Windows of an anchor that are settled together where possible.
BLOCK = 16

_RNG = np.random.Generator(np.random.PCG64(424242))
_TABLES = [_RNG.integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64) * U(2) + U(1) for _ in range(2)]
_POWERS = [Powers(0xD1342543DE82EF95), Powers(0xAF251AF3B0F025B5)]


class Fingerprints:
    """Fingerprints of any stretch of a buffer from running sums."""

    def __init__(self, data: np.ndarray, which: int = 0):
        n = len(data)
        self.powers = _POWERS[which]
        self.powers.upto(n + 1)
        self.sums = np.zeros(n + 1, U)
        np.cumsum(_TABLES[which][data] * self.powers.up[:n], out=self.sums[1:])

    def at(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.powers.down[start])

    def every(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return mix((self.sums[length:] - self.sums[:n]) * self.powers.down[:n])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values."""
    n = len(x)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, U)
    padded[:n] = x
    grid = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


class Sampler:
    """Anchors of the windows of a buffer of whole texts."""

    def __init__(self, length: int = 400):
        if length < 8 or length % 4 or length > BUFFER:
            raise ValueError(f"the length is a multiple of 4, from 8 to {BUFFER}")
        self.length, self.first = length, length // 4

    def anchors(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> dict[str, np.ndarray]:
        """Per anchor: text number, place, first and last window start, ranks to the right and left, fingerprint of its
        whole neighbourhood. Places count from the start of the buffer."""
        length, k = self.length, self.first
        out = {c: np.zeros(0, U if c[0] in "rlf" else np.int64) for c in ("text", "at", "lo", "hi", "r0", "r1", "r2", "l1", "l2", "l3", "f1", "f2")}
        if len(data) < length:
            return out
        fp = Fingerprints(data)
        h = fp.every(k)
        keys = (h & ~_MASK) | np.arange(len(h), dtype=U)
        at = (sliding_min(keys, length - k + 1) & _MASK).astype(np.int64)  # at[p]: anchor of the window at p
        whole = np.zeros(len(at) + 1, np.int8)
        has = ends - starts >= length
        np.add.at(whole, starts[has], 1)
        np.add.at(whole, np.minimum(ends[has] - length + 1, len(at)), -1)
        valid = np.cumsum(whole[:-1]).astype(bool)
        change = np.ones(len(at), bool)
        change[1:] = (at[1:] != at[:-1]) | (valid[1:] != valid[:-1])
        change[starts[(starts < len(at))]] = True
        lo = np.flatnonzero(change)
        hi = np.concatenate([lo[1:], [len(at)]]) - 1
        keep = valid[lo]
        lo, hi = lo[keep], hi[keep]
        a = at[lo]
        text = np.searchsorted(starts, lo, side="right") - 1
        s, e = starts[text], ends[text]

        def rank(start: np.ndarray, end: np.ndarray) -> np.ndarray:
            """0 where the stretch leaves the text: no rank."""
            inside = (start >= s) & (end <= e)
            r = fp.at(np.where(inside, start, 0), np.where(inside, end, 0)) | U(1)
            return np.where(inside, r, U(0))

        fp2 = Fingerprints(data, 1)
        shape = (a - lo).astype(U)
        return {
            "text": text, "at": a, "lo": lo, "hi": hi,
            "r0": rank(a, a + k), "r1": rank(a + k, a + 2 * k), "r2": rank(a + 2 * k, a + 4 * k),
            "l1": rank(a - k, a), "l2": rank(a - 2 * k, a - k), "l3": rank(a - 3 * k, a - 2 * k),
            "f1": mix(fp.at(lo, hi + length) ^ mix(shape)), "f2": fp2.at(lo, hi + length),
        }


def buffers(texts: list[bytes | None], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """data, row numbers, offsets within the rows, starts and ends of pieces. Long texts are cut into pieces that overlap
    by length - 1 bytes, so each window is in one piece. No buffer has more positions than a packed key can hold."""
    part: list[bytes] = []
    rows: list[int] = []
    offsets: list[int] = []
    size = 0

    def pack():
        ends = np.cumsum([len(p) for p in part])
        return np.frombuffer(b"".join(part), np.uint8), np.array(rows), np.array(offsets), ends - [len(p) for p in part], ends

    for row, t in enumerate(texts):
        if not t or len(t) < length:
            continue
        for o in range(0, len(t) - length + 1, BUFFER):
            piece = t[o : o + BUFFER + length - 1]
            if size + len(piece) > 1 << _BITS:
                yield pack()
                part, rows, offsets, size = [], [], [], 0
            part.append(piece)
            rows.append(row)
            offsets.append(o)
            size += len(piece)
            if size >= BUFFER:
                yield pack()
                part, rows, offsets, size = [], [], [], 0
    if part:
        yield pack()


ANCHORS = "doc_id long, h long, at long, lo long, hi long, r0 long, r1 long, r2 long, l1 long, l2 long, l3 long, f1 long, f2 long"
_RANKS = ("r0", "r1", "r2", "l1", "l2", "l3", "f1", "f2")


def _anchors(length: int, only_rank: bool):
    sampler = Sampler(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in batches_of(pa.Table.from_batches([big]), 512):
                texts = batch.column("text").cast(pa.binary()).to_pylist()
                docs, h = batch.column("doc_id"), batch.column("h")
                for data, rows, offsets, starts, ends in buffers(texts, length):
                    a = sampler.anchors(data, starts, ends)
                    if only_rank:
                        yield pa.RecordBatch.from_pydict({"r0": a["r0"].view(np.int64)})
                        continue
                    row = rows[a["text"]]
                    shift = offsets[a["text"]] - starts[a["text"]]
                    yield pa.RecordBatch.from_pydict(
                        {"doc_id": docs.take(pa.array(row)), "h": h.take(pa.array(row))} | {c: a[c] + shift for c in ("at", "lo", "hi")} | {c: a[c].view(np.int64) for c in _RANKS}
                    )

    return run


def _positions(k: int, length: int):
    """Rank of the first k bytes of every suffix that has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in batches_of(pa.Table.from_batches([big]), 64):
                for row, n, text in zip(batch.column("row").to_pylist(), batch.column("n").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                    for o in range(0, len(text) - k + 1, BUFFER):
                        rank = Fingerprints(np.frombuffer(text[o : o + BUFFER + k - 1], np.uint8)).every(k)
                        yield pa.RecordBatch.from_pydict({"row": np.full(len(rank), row), "n": np.full(len(rank), n), "at": np.arange(len(rank)) + o, "rank": rank.view(np.int64)})

    return run


def _windows(length: int):
    """Fingerprints of the windows lo to hi of each listed anchor of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in batches_of(pa.Table.from_batches([big]), 64):
                for text, anchors in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("anchors").to_pylist(), strict=True):
                    ids, at, lo, hi = (np.array([x[k] for x in anchors], np.int64) for k in ("id", "at", "lo", "hi"))
                    # Only the stretch that the anchors touch is hashed; it is cut so that memory stays bounded.
                    order = np.argsort(lo, kind="stable")
                    for part in np.array_split(order, max(1, int((hi - lo + 1).sum()) // BUFFER + 1)):
                        if not len(part):
                            continue
                        base, end = int(lo[part].min()), int(hi[part].max()) + length
                        data = np.frombuffer(text, np.uint8, end - base, base)
                        n = hi[part] - lo[part] + 1
                        pos = np.repeat(lo[part] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                        fps = [Fingerprints(data, w).at(pos - base, pos - base + length) for w in (0, 1)]
                        # The anchor's place in the window goes into the key: equal windows have it at the same place.
                        place = (np.repeat(at[part], n) - pos).astype(U)
                        yield pa.RecordBatch.from_pydict({"id": np.repeat(ids[part], n), "pos": pos.astype(np.int32), "k1": mix(fps[0] ^ mix(place)).view(np.int64), "k2": fps[1].view(np.int64)})

    return run


def _blocks(length: int):
    """Of each listed anchor, its windows by BLOCK places: `core`, the bytes that all windows of a block share, and h1, h2,
    the fingerprint of all the bytes under them, null where the block leaves the anchor's range. Blocks are aligned to the
    anchor, so equal windows are in equal blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in batches_of(pa.Table.from_batches([big]), 64):
                for text, anchors in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("anchors").to_pylist(), strict=True):
                    ids, at, lo, hi = (np.array([x[k] for x in anchors], np.int64) for k in ("id", "at", "lo", "hi"))
                    data = np.frombuffer(text, np.uint8)
                    first, n = (at - hi) // BLOCK, (at - lo) // BLOCK - (at - hi) // BLOCK + 1
                    own = np.repeat(np.arange(len(ids)), n)
                    block = first[own] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    last = at[own] - block * BLOCK
                    start = last - BLOCK + 1
                    whole = (start >= lo[own]) & (last <= hi[own])
                    fps = [Fingerprints(data, w) for w in (0, 1)]
                    core = mix(fps[0].at(last, start + length) ^ mix(block.astype(U)))
                    hull = [f.at(np.where(whole, start, 0), np.where(whole, last + length, 0)) for f in fps]
                    null = ~whole
                    yield pa.RecordBatch.from_pydict(
                        {
                            "id": ids[own], "at": at[own], "lo": np.maximum(start, lo[own]), "hi": np.minimum(last, hi[own]), "core": core.view(np.int64),
                            "h1": pa.array(mix(hull[0] ^ mix(block.astype(U))).view(np.int64), mask=null), "h2": pa.array(hull[1].view(np.int64), mask=null),
                        }
                    )

    return run


def _merge(length: int):
    """Byte runs covered by windows that start in the given ranges, merged where they touch or overlap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for ranges in batch.column("ranges").to_pylist():
                lo = np.array([r["lo"] for r in ranges], np.int64)
                hi = np.array([r["hi"] for r in ranges], np.int64) + length
                order = np.argsort(lo, kind="stable")
                lo, hi = lo[order], np.maximum.accumulate(hi[order])
                new = np.concatenate([[True], lo[1:] > hi[:-1]])
                cut = np.flatnonzero(new)
                out.append([{"start": int(s), "end": int(e)} for s, e in zip(lo[cut], hi[np.concatenate([cut[1:], [len(lo)]]) - 1], strict=True)])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "h": batch.column("h"), "spans": pa.array(out, kind)})

    return run


def _cut(keep_bytes: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in batches_of(pa.Table.from_batches([big]), 512):
                n, gone, runs, sha, kept = [], [], [], [], []
                for text, spans in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist(), strict=True):
                    t, spans = text or b"", spans or []
                    at, parts = 0, []
                    for s in spans:
                        parts.append(t[at : s["start"]])
                        at = s["end"]
                    rest = b"".join([*parts, t[at:]])
                    n.append(len(t))
                    gone.append(len(t) - len(rest))
                    runs.append(len(spans))
                    sha.append(hashlib.sha256(rest).hexdigest())
                    kept.append(rest)
                out = {"doc_id": batch.column("doc_id"), "n_bytes": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "n_spans": pa.array(runs, pa.int64()), "kept_sha256": pa.array(sha, pa.string()), "spans": batch.column("spans")}
                yield pa.RecordBatch.from_pydict(out | ({"kept": pa.array(kept, pa.binary())} if keep_bytes else {}))

    return run


class SuffixDedup:
    """Removes each byte covered by a string of `length` bytes that also starts elsewhere in the table."""

    def __init__(self, docs: DataFrame, length: int = 400):
        # Rows are known by doc_id and a hash of the text; equal rows have equal spans.
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("h", F.xxhash64("text"))
        self.length = length
        self.scratch = Scratch(docs.sparkSession, "suffix")

    def repeated_ranges(self) -> DataFrame:
        """doc_id, h, lo, hi: starts of repeated windows."""
        s, length, k = self.scratch, self.length, self.length // 4
        long_enough = self.docs.where(F.octet_length("text") >= length)
        ranks = long_enough.mapInArrow(_anchors(length, True), "r0 long").groupBy("r0").agg(F.count("*").alias("n")).where("n > 1").select("r0")
        ranks = s.save(ranks, "ranks-0")
        anchors = long_enough.mapInArrow(_anchors(length, False), ANCHORS).join(small(ranks, 4_000_000), "r0", "left_semi")
        anchors = s.save(anchors, "anchors")

        # Kinds of neighbourhood: those seen twice are settled, and one anchor of each kind stands for the others.
        rest = F.struct("doc_id", "h", "at", "lo", "hi", "r0", "r1", "r2", "l1", "l2", "l3")
        kinds = s.save(anchors.groupBy("f1", "f2").agg(F.count("*").alias("n"), F.min(rest).alias("v")), "kinds")
        twins = anchors.join(kinds.where("n > 1").select("f1", "f2"), ["f1", "f2"], "left_semi").select("doc_id", "h", "lo", "hi")
        v = kinds.select("n", "v.*")
        open_ranks = v.groupBy("r0").agg(F.min("n").alias("least"), F.count("*").alias("kinds")).where("least = 1 and kinds > 1").select("r0")
        v = s.save(v.join(open_ranks, "r0", "left_semi"), "open")

        # Doubling to the right (to 2k and 4k bytes) and, by k bytes at a time, to the left.
        for rank, following, name in (("r0", "r1", "right2"), ("right2", "r2", "right4"), ("r0", "l1", "left1"), ("left1", "l2", "left2"), ("left2", "l3", "left3")):
            v = self.rerank(v, rank, following, name)
        right = F.when(F.col("right4").isNotNull(), 4 * k).when(F.col("right2").isNotNull(), 4 * k - 1).otherwise(2 * k - 1)
        left = F.when(F.col("left3").isNotNull(), 3 * k).when(F.col("left2").isNotNull(), 3 * k - 1).when(F.col("left1").isNotNull(), 2 * k - 1).otherwise(k - 1)
        v = v.withColumn("lo2", F.greatest("lo", F.col("at") - left)).withColumn("hi2", F.least("hi", F.col("at") + right - length)).where("lo2 <= hi2")
        v = v.select("n", "doc_id", "h", "at", F.col("lo2").alias("lo"), F.col("hi2").alias("hi"), F.monotonically_increasing_id().alias("id"))
        v = s.save(v, "left-over")

        # Blocks of windows: all repeat if all their bytes have a twin, none does if their common bytes have none.
        blocks = s.save(self.listed(v).mapInArrow(_blocks(length), "id long, at long, lo long, hi long, core long, h1 long, h2 long"), "blocks")
        hulls = s.save(blocks.where("h1 is not null").groupBy("h1", "h2", "core").agg(F.count("*").alias("members"), F.min(F.struct("id", "at", "lo", "hi")).alias("v")), "hulls")
        settled = blocks.join(hulls.where("members > 1").select("h1", "h2"), ["h1", "h2"], "left_semi").select("id", "lo", "hi")
        # What is not settled, and one block of each settled kind, since its windows may have twins among the others.
        loose = hulls.select("core", F.col("members"), "v.*").unionByName(blocks.where("h1 is null").select("core", F.lit(1).cast("long").alias("members"), "id", "at", "lo", "hi"))
        cores = loose.groupBy("core").agg(F.min("members").alias("least"), F.count("*").alias("n")).where("least = 1 and n > 1").select("core")
        loose = loose.join(cores, "core", "left_semi").select("id", "at", "lo", "hi")
        loose = loose.join(v.select("id", "doc_id", "h"), "id")
        windows = s.save(self.listed(loose).mapInArrow(_windows(length), "id long, pos int, k1 long, k2 long"), "windows")
        twice = windows.groupBy("k1", "k2").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("k1", "k2")
        single = windows.join(twice, ["k1", "k2"], "left_semi").select("id", F.col("pos").cast("long").alias("lo"), F.col("pos").cast("long").alias("hi"))
        again = settled.unionByName(single).join(v.where("n = 1").select("id", "doc_id", "h"), "id").select("doc_id", "h", "lo", "hi")
        return twins.unionByName(again)

    def every_position(self) -> DataFrame:
        """doc_id, h, lo, hi of repeated windows by prefix doubling over all suffixes: pairs of the ranks at a place and at the
        growing offset are sorted and reranked, suffixes go once they are unique, and those left at `length` bytes repeat.

        Ranks of the first length / 16 bytes are 64-bit fingerprints. This is the plain form of the method and the standard
        that the sampled form is tested against; every byte is a row of each round, so it is for small tables."""
        if self.length % 16:
            raise ValueError("the length is a multiple of 16")
        s, size = self.scratch, self.length // 16
        docs = self.docs.where(F.octet_length("text") >= self.length).groupBy("doc_id", "h").agg(F.first("text").alias("text"), F.count("*").alias("n"))
        docs = s.save(docs.withColumn("row", F.monotonically_increasing_id()), "rows")
        r = s.save(docs.select("row", "n", "text").mapInArrow(_positions(size, self.length), "row long, n long, at long, rank long"), "suffixes-0")
        r = r.join(r.groupBy("rank").agg(F.sum("n").alias("m")).where("m > 1").select("rank"), "rank", "left_semi")
        while size < self.length:
            ahead = r.select("row", (F.col("at") - size).alias("at"), F.col("rank").alias("following"))
            pairs = s.save(r.join(ahead, ["row", "at"]), f"pairs-{size}")
            ranks = pairs.groupBy("rank", "following").agg(F.sum("n").alias("m")).where("m > 1").orderBy("rank", "following")
            ranks = s.save(ranks.select("rank", "following", F.monotonically_increasing_id().alias("new")), f"pair-ranks-{size}")
            size *= 2
            r = s.save(pairs.join(ranks, ["rank", "following"]).select("row", "n", "at", F.col("new").alias("rank")), f"suffixes-{size}")
        return r.join(docs.select("row", "doc_id", "h"), "row").select("doc_id", "h", F.col("at").alias("lo"), F.col("at").alias("hi"))

    def rerank(self, v: DataFrame, rank: str, following: str, name: str) -> DataFrame:
        """v with the rank of the longer prefix, null where it leaves the text or is unique: the pair of the rank so far and
        the rank of the bytes that follow. A frequent pair is counted where it is before it moves, and only the pairs that
        occur twice come back."""
        v = v.withColumn(name, F.when((F.col(following) != 0) & F.col(rank).isNotNull(), F.xxhash64(rank, following)))
        shared = v.where(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("n")).where("n > 1").select(name, F.lit(True).alias("_shared"))
        shared = self.scratch.save(shared, f"ranks-{name}")
        return v.join(small(shared), name, "left").withColumn(name, F.when(F.col("_shared"), F.col(name))).drop("_shared")

    def listed(self, v: DataFrame) -> DataFrame:
        """The texts of listed anchors with those anchors in one array, bounded by the length of the text."""
        return self.picked(self.scratch.save(v.groupBy("doc_id", "h").agg(F.collect_list(F.struct("id", "at", "lo", "hi")).alias("anchors")), f"listed-{uuid.uuid4().hex}"))

    def picked(self, rows: DataFrame) -> DataFrame:
        keys = rows.withColumnRenamed("doc_id", "d").withColumnRenamed("h", "g")
        return self.docs.join(small_lists(keys, "anchors"), self.docs["doc_id"].eqNullSafe(F.col("d")) & (self.docs["h"] == F.col("g")))

    def run(self, keep_bytes: bool = False, sampled: bool = True) -> DataFrame:
        """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (and kept, the remaining bytes) of each row. sampled: by
        sampled suffixes, else by all of them; both give the same rows."""
        # Equal rows have equal ranges: each is kept once, where it is found, so a million copies gather no more than one row.
        ranges = (self.repeated_ranges() if sampled else self.every_position()).groupBy("doc_id", "h").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges"))
        spans = ranges.mapInArrow(_merge(self.length), "doc_id long, h long, spans array<struct<start: long, end: long>>")
        spans = self.scratch.save(spans, "spans")
        self.scratch.keep("spans")
        spans = spans.withColumnRenamed("doc_id", "d").withColumnRenamed("h", "g")
        joined = self.docs.join(small_lists(spans, "spans"), self.docs["doc_id"].eqNullSafe(F.col("d")) & (self.docs["h"] == F.col("g")), "left").select("doc_id", "text", "spans")
        schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, end: long>>"
        return joined.mapInArrow(_cut(keep_bytes), schema + ", kept binary" * keep_bytes)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SuffixDedup(table(spark, sf_dir, "documents")).run().drop("spans").withColumn("repeats", F.col("n_removed") > 0)
