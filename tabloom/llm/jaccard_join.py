"""Jaccard join of documents on five-word shingles: count vectors in R-trees, bounded by summed coordinate minima.

A document's shingles are hashed into 256 groups; the group counts are its point. The overlap of two documents is at most
the sum of the smaller counts, so a pair whose sum is below what the threshold needs is out. Points are tiled by size
class and, within a block, packed into the leaves of an R-tree; two leaves are compared only if the sum of the smaller upper
corners, and their sizes, allow an overlap. Pairs that survive are verified on their whole shingle sets.

An R-tree over all points would compare most leaves: in many dimensions boxes overlap. So trees are built per
block: two documents over the threshold share a shingle among the first fifth of either in any fixed order (the
prefix principle, exact); the order is by hash with frequent shingles last, and blocks are the documents that share such a shingle. Blocks with the same members are kept once.

Only components are asked for, so a large block needn't yield all its pairs: round 1 gives each document its most likely
and a few other partners per block, and all pairs of small blocks; round 2 looks at the large blocks again and yields every
pair that is not yet in one component. After round 2 every pair of the whole table is verified, bounded away, or inside one component.

Null and edge cases: null and blank texts have no shingles and link with nothing; texts under five words are one shingle;
equal sets are one class from the start, so copies never make pairs; rows with one doc_id are one node; a row with a null
doc_id has a null component; extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, batches_of, saved_components, small, table
from .shingles import mix, shingle_set, word_hashes

GROUPS = 256
#: Blocks up to this size give all their surviving pairs at once.
SMALL_BLOCK = 16
#: Most documents of a tile; larger blocks become pairs of tiles.
TILE = 2048
LEAF = 32
#: Coordinates of the boxes: the groups folded.
FOLDED = 32
#: Shingles of at least so many texts go last in prefixes; at most so many are known to the tasks (16 MB); and so many
#: a task counts at a time.
FREQUENT_TEXTS = 6
FREQUENT_KEPT = 1_000_000
FREQUENT_HELD = 8_000_000
#: Texts whose copies a task recognises while it counts; copies beyond only change the order of prefixes.
SEEN_TEXTS = 1_000_000
#: Components of candidates with more shingles or pairs are verified pair by pair: a task's group stays small.
GROUP_SHINGLES = 1 << 18
GROUP_PAIRS = 1 << 12

SKETCH = "doc_id long, n long, k1 long, k2 long, points binary, prefix array<long>"


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def count_vector(s: np.ndarray) -> bytes:
    """Group counts in the narrowest unsigned type that holds them."""
    counts = np.bincount((s & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS)
    top = counts.max(initial=0)
    return counts.astype("<u1" if top < 256 else "<u2" if top < 65536 else "<u4").tobytes()


def point(data: bytes) -> np.ndarray:
    return np.frombuffer(data, {1: "<u1", 2: "<u2", 4: "<u4"}[len(data) // GROUPS])


def points(rows: list[bytes]) -> np.ndarray:
    """A matrix of count vectors in one type."""
    return np.stack([point(r) for r in rows])


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles that several different texts of a task hold, with how many of its texts do."""
    held, size = [], 0
    tokens, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    seen: set[int] = set()

    def merge() -> None:
        nonlocal held, size, tokens, counts
        new, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_counts=True)
        both = np.concatenate([tokens, new])
        order = np.argsort(both, kind="stable")
        c = np.concatenate([counts, n])[order]
        both = both[order]
        cut = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.zeros(0, np.int64)
        tokens, counts = both[cut], np.add.reduceat(c, cut) if len(cut) else c
        held, size = [], 0
        if len(tokens) > FREQUENT_HELD:  # lossy counting: what is rare so far goes
            tokens, counts = tokens[counts > 1], counts[counts > 1]

    for big in batches:
        for batch in batches_of(pa.Table.from_batches([big]), 256):
            for w in word_hashes(batch.column("text").cast(pa.binary()).to_pylist()):
                s = shingle_set(w)
                key = hash(s.tobytes())
                if len(s) and key not in seen:
                    if len(seen) >= SEEN_TEXTS:
                        seen.clear()
                    seen.add(key)
                    held.append(s)
                    size += len(s)
            if size > FREQUENT_HELD // 2:
                merge()
    merge()
    often = counts > 1
    yield pa.RecordBatch.from_pydict({"token": _signed(tokens[often]), "n": counts[often]})


def by_rarity(s: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """A set in the order of the prefix principle: frequent shingles last, by hash otherwise. Any order that is the
    same for all documents gives the same links; this one keeps frequent shingles out of most prefixes."""
    if not len(frequent) or not len(s):
        return s
    at = np.searchsorted(frequent, s)
    at[at == len(frequent)] = 0
    often = frequent[at] == s
    return np.concatenate([s[~often], s[often]])


def _sketch(percent: int, frequent: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in batches_of(pa.Table.from_batches([big]), 256):
                sets = [shingle_set(w) for w in word_hashes(batch.column("text").cast(pa.binary()).to_pylist())]
                n = np.array([len(s) for s in sets], np.int64)
                # A pair at the threshold shares all but this many of either's shingles, so one of the first of them.
                take = [m - -(-percent * m // 100) + 1 if m else 0 for m in n.tolist()]
                prefixes = [by_rarity(s, frequent)[:t] for s, t in zip(sets, take, strict=True)]
                key = lambda c: pa.array(np.array([np.bitwise_xor.reduce((s * np.uint64(c)) ^ (s >> np.uint64(29))) if len(s) else 0 for s in sets], np.uint64).view(np.int64))  # noqa: B023, E731
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column("doc_id"),
                        "n": n,
                        "k1": key(0xC2B2AE3D27D4EB4F),
                        "k2": key(0x165667B19E3779F9),
                        "points": pa.array([count_vector(s) for s in sets], pa.binary()),
                        "prefix": pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32), _signed(np.concatenate(prefixes)) if prefixes else []),
                    }
                )

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for big in batches:
        for batch in batches_of(pa.Table.from_batches([big]), 256):
            sets = [shingle_set(w) for w in word_hashes(batch.column("text").cast(pa.binary()).to_pylist())]
            flat = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32), _signed(np.concatenate(sets)))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "shingles": flat})


def enough(bound: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Whether an overlap of bound can reach the threshold for two sets with this sum of sizes."""
    return (100 + percent) * bound.astype(np.int64) >= percent * sizes


class RTree:
    """Leaves of points packed in order of size and first coordinates. Boxes keep upper corners, over groups folded to
    FOLDED coordinates: the sum of the smaller upper coordinates bounds the overlap of any two points inside."""

    def __init__(self, n: np.ndarray, p: np.ndarray):
        c = p.reshape(len(p), FOLDED, -1).sum(axis=2, dtype=np.uint32).astype(np.uint16 if n.max(initial=0) < 65536 else np.uint32)
        self.order = np.lexsort((c[:, 0], n))
        self.n, self.p, self.c = n[self.order], p[self.order], c[self.order]
        self.cuts = np.arange(0, len(n), LEAF)
        self.upper = np.maximum.reduceat(self.c, self.cuts) if len(n) else self.c
        self.least, self.most = self.n[self.cuts], self.n[np.minimum(self.cuts + LEAF, len(n)) - 1]

    def join(self, other: RTree, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Row numbers (in the inputs) and bounds of the pairs that survive, leaf by leaf."""
        for a, at in enumerate(self.cuts):
            b = np.flatnonzero((100 * other.most >= percent * self.least[a]) & (100 * self.most[a] >= percent * other.least))
            if len(b):
                b = b[enough(np.minimum(self.upper[a], other.upper[b]).sum(axis=1, dtype=np.int64), self.least[a] + other.least[b], percent)]
            if not len(b):
                continue
            rows = (other.cuts[b][:, None] + np.arange(LEAF)).ravel()
            rows = rows[rows < len(other.n)]
            mine = slice(at, min(at + LEAF, len(self.n)))
            near = np.minimum(self.c[mine][:, None, :], other.c[rows][None, :, :]).sum(axis=2, dtype=np.int64)
            x, y = self.n[mine][:, None], other.n[rows][None, :]
            i, j = np.nonzero((100 * x >= percent * y) & (100 * y >= percent * x) & enough(near, x + y, percent))
            if not len(i):
                continue
            i, j = i + at, rows[j]
            bound = np.minimum(self.p[i], other.p[j]).sum(axis=1, dtype=np.int64)
            keep = enough(bound, self.n[i] + other.n[j], percent)
            yield self.order[i[keep]], other.order[j[keep]], bound[keep]


def _first_of_each(group: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Mask of the k entries with the smallest score of each group."""
    order = np.lexsort((score, group))
    g = group[order]
    start = np.concatenate([[True], g[1:] != g[:-1]])
    rank = np.arange(len(g)) - np.maximum.accumulate(np.where(start, np.arange(len(g)), 0))
    mask = np.zeros(len(g), bool)
    mask[order[rank < k]] = True
    return mask


def _blocks(percent: int, partners: int | None):
    """Pairs of a tile pair. partners: of each document, so many of the likeliest and as many others; None: all whose
    components differ."""

    def pairs(g: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        ids = g.column("doc_id").to_numpy()
        n = g.column("n").to_numpy()
        comp = g.column("component").to_numpy()
        side = g.column("side").to_numpy()
        left, right = np.flatnonzero(side != 2), np.flatnonzero(side != 1)
        if not len(left) or not len(right) or partners is None and (comp == comp[0]).all():
            return ids[:0], ids[:0]
        p = points(g.column("points").to_pylist())
        found = [(ids[:0], ids[:0], ids[:0])]
        for i, j, bound in RTree(n[left], p[left]).join(RTree(n[right], p[right]), percent):
            a, b = left[i], right[j]
            # Rows that sit on both sides (side 0) meet twice.
            ok = (ids[a] != ids[b]) & ((side[a] != 0) | (side[b] != 0) | (ids[a] < ids[b])) & ((comp[a] != comp[b]) if partners is None else True)
            found.append((a[ok], b[ok], bound[ok]))
        a, b, bound = (np.concatenate(x) for x in zip(*found, strict=True))
        if partners is not None and len(ids) > SMALL_BLOCK and len(a):
            x, y = ids[a].astype(np.uint64), ids[b].astype(np.uint64)
            draw = mix(x * np.uint64(0x9E3779B97F4A7C15) ^ y * np.uint64(0xC2B2AE3D27D4EB4F))
            score = -bound / (n[a] + n[b])
            # Both ends choose, so a document with few partners keeps them all.
            keep = np.zeros(len(a), bool)
            for end in (a, b):
                keep |= _first_of_each(end, score, partners) | _first_of_each(end, draw, partners)
            a, b = a[keep], b[keep]
        u = np.unique(np.stack([np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b])]), axis=1)
        return u[0], u[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups_of(batches, "block"):
            a, b = pairs(g)
            if len(a):
                yield pa.RecordBatch.from_pydict({"a": a, "b": b})

    return run


def groups_of(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Rows of one key at a time, from batches sorted by it."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
        whole = pa.Table.from_batches([batch])
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            if held and keys[s] != last:
                yield pa.concat_tables(held).combine_chunks()
                held = []
            last = keys[s]
            held.append(whole.slice(s, e - s))
    if held:
        yield pa.concat_tables(held).combine_chunks()


def _verify(percent: int):
    """Pairs of a group that reach the threshold, from the group's texts; a pair already joined through others is not
    looked at again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups_of(batches, "group"):
            is_text = g.column("b").is_null()
            texts, pairs = g.filter(is_text), g.filter(pc.invert(is_text))
            ids = texts.column("a").to_pylist()
            sets: dict[int, list[np.ndarray]] = {}
            for i, w in zip(ids, word_hashes(texts.column("text").cast(pa.binary()).to_pylist()), strict=True):
                sets.setdefault(i, []).append(shingle_set(w))
            root = {i: i for i in sets}

            def find(x: int) -> int:
                while root[x] != x:  # noqa: B023
                    root[x] = root[root[x]]  # noqa: B023
                    x = root[x]  # noqa: B023
                return x

            out = []
            for a, b in zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist(), strict=True):
                x, y = find(a), find(b)
                if x != y and any((100 + percent) * shared_count(s, t) >= percent * (len(s) + len(t)) for s in sets[a] for t in sets[b]):
                    root[max(x, y)] = min(x, y)
                    out.append((a, b))
            if out:
                yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return run


def shared_count(s: np.ndarray, t: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(s) > len(t):
        s, t = t, s
    at = np.searchsorted(t, s)
    at[at == len(t)] = 0
    return int((t[at] == s).sum()) if len(t) else 0


class JaccardJoin:
    """links() of documents with a Jaccard similarity of percent / 100 or more on five-word shingles."""

    def __init__(self, docs: DataFrame, percent: int = 80, partners: int = 4):
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        self.percent, self.partners = percent, partners
        self.spark = docs.sparkSession
        self.scratch = Scratch(self.spark, "jaccard")

    def run(self) -> DataFrame:
        """doc_id, n_shingles, component_id for each row."""
        s, percent = self.scratch, self.percent
        sketch = s.save(self.docs.mapInArrow(_sketch(percent, self.frequent()), SKETCH), "sketch")
        classes = s.save(sketch.where("n > 0").groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("rep")), "classes")
        reps = s.save(classes.where("rep is not null").select(F.col("rep").alias("doc_id")).distinct(), "reps")
        members = sketch.where("n > 0").join(small(reps, count=s.rows["reps"]), "doc_id", "left_semi")
        entries = members.select(F.explode("prefix").alias("token"), "doc_id", "n")
        # Most shingles stand in one document only: they go before more than themselves is shuffled.
        often = s.save(entries.groupBy("token").agg(F.count("*").alias("df")).where("df > 1").select("token"), "often")
        shared = s.save(entries.join(small(often, count=s.rows["often"]), "token", "left_semi"), "shared")
        blocks = shared.groupBy("token").agg(F.count("*").alias("df"), F.bit_xor(F.xxhash64("doc_id")).alias("x"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
        blocks = s.save(blocks.groupBy("df", "x", "lo", "hi").agg(F.min("token").alias("token")).select("token", "df"), "blocks")
        placed = s.save(shared.join(small(blocks, count=s.rows["blocks"]), "token"), "placed")
        most = blocks.agg(F.max("df")).first()[0] or 0

        first = s.save(self.blocked(placed, sketch, None, most).distinct(), "pairs-1")
        links = s.save(self.verified(first, sketch, s.rows["pairs-1"]), "links-1")
        found = saved_components(links, s, "components", "a", "b")
        if most > SMALL_BLOCK:
            rest = s.save(self.blocked(placed, sketch, found, most).distinct().join(first, ["a", "b"], "left_anti"), "pairs-2")
            if s.rows["pairs-2"]:
                links = links.unionByName(s.save(self.verified(rest, sketch, s.rows["pairs-2"]), "links-2"))
                found = saved_components(links, s, "components-2", "a", "b")
        s.keep("sketch", "classes", "components", "components-2")
        named = sketch.select("doc_id", "n", "k1", "k2").join(classes, ["n", "k1", "k2"], "left")
        return (
            named.withColumn("node", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")))
            .join(found, "node", "left")
            .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "node").alias("component_id"))
        )

    def frequent(self) -> np.ndarray:
        """The most frequent shingles, sorted: those of FREQUENT_TEXTS texts or more as far as the tasks saw them more than
        once, at most FREQUENT_KEPT. They only set the order of prefixes, so what is missed costs time, not links."""
        counts = self.docs.mapInArrow(_frequent, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT_TEXTS)
        kept = counts.orderBy(F.desc("n"), "token").limit(FREQUENT_KEPT).select("token").toArrow().column("token").to_numpy()
        return np.sort(kept.view(np.uint64))

    def blocked(self, placed: DataFrame, sketch: DataFrame, found: DataFrame | None, most: int) -> DataFrame:
        """Pairs from the trees of the blocks, of which the largest has `most` documents: all pairs of blocks up to
        SMALL_BLOCK and a few of each document of larger ones, or with components found all of those that are still apart."""
        rows = placed
        if found is None:
            rows = rows.withColumn("component", F.col("doc_id"))
        else:
            rows = rows.where(F.col("df") > SMALL_BLOCK)
            rows = rows.join(small(found.withColumnRenamed("node", "doc_id"), count=self.scratch.rows["components"]), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
            spread = rows.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("token")
            rows = rows.join(spread, "token", "left_semi")
        seated = rows.where(F.col("df") <= TILE).select("doc_id", "n", "component", F.lit(0).alias("side"), F.col("token").alias("block"))
        if most > TILE:
            seated = seated.unionByName(self.tiled(rows.where(F.col("df") > TILE)))
        points = seated.join(sketch.where("n > 0").select("doc_id", "points"), "doc_id")
        return points.repartition("block").sortWithinPartitions("block").mapInArrow(_blocks(self.percent, self.partners if found is None else None), "a long, b long")

    def tiled(self, big: DataFrame) -> DataFrame:
        """Seats of blocks over TILE. A block is cut by size class (a document also visits the class below, so sizes
        within the threshold meet), and a class over TILE documents into pairs of tiles."""
        step = float(np.log(100 / self.percent))
        big = big.withColumn("class", F.floor(F.log(F.col("n").cast("double")) / step + 1e-9))
        tiles = big.groupBy("token", "class").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
        near = tiles.select("token", (F.col("class") - 1).alias("class"), F.col("tiles").alias("above"))
        under = tiles.select("token", (F.col("class") + 1).alias("class"), F.col("tiles").alias("below"))
        sized = big.join(tiles, ["token", "class"]).join(near, ["token", "class"], "left").join(under, ["token", "class"], "left")
        tile = F.pmod(F.xxhash64("doc_id"), F.col("tiles")).cast("int")
        # Side 0: both sides of a tile with itself; 1 and 2: left and right of two different tiles.
        seat = lambda c, i, j, side: F.struct(c.alias("class"), i.alias("i"), j.alias("j"), F.lit(side).alias("side"))
        upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        home = F.transform(upto(F.col("tiles")), lambda j: F.when(j == F.col("tile"), seat(F.col("class"), j, j, 0)).when(j > F.col("tile"), seat(F.col("class"), F.col("tile"), j, 1)).otherwise(seat(F.col("class"), j, F.col("tile"), 2)))
        up = F.transform(upto(F.coalesce("above", F.lit(0))), lambda j: seat(F.col("class"), -F.col("tile") - 1, j, 1))
        down = F.transform(upto(F.coalesce("below", F.lit(0))), lambda j: seat(F.col("class") - 1, -j - 1, F.col("tile"), 2))
        seated = sized.withColumn("tile", tile).select("token", "doc_id", "n", "component", F.explode(F.concat(home, up, down)).alias("s"))
        return seated.select("doc_id", "n", "component", F.col("s.side").alias("side"), F.xxhash64("token", "s.class", "s.i", "s.j").alias("block"))

    def verified(self, pairs: DataFrame, sketch: DataFrame, n_pairs: int) -> DataFrame:
        """Pairs whose whole shingle sets reach the threshold, enough of them to have the same components.

        Candidate pairs passed a tight bound, so their own components are small: each text moves once, to its component.
        A component with more than GROUP_SHINGLES shingles or GROUP_PAIRS pairs is verified pair by pair instead, by joins."""
        group = saved_components(pairs, self.scratch, f"groups-{uuid.uuid4().hex}", "a", "b")
        weight = group.join(sketch.select(F.col("doc_id").alias("node"), "n"), "node").groupBy("component").agg(F.sum("n").alias("w"))
        work = pairs.join(group.withColumnRenamed("node", "a"), "a").groupBy("component").agg(F.count("*").alias("p"))
        big = (F.col("w") > GROUP_SHINGLES) | (F.col("p") > GROUP_PAIRS)
        sized = weight.join(work, "component").select("component", big.alias("big"))
        placed = self.scratch.save(group.join(sized, "component").select("node", F.col("component").alias("group"), "big"), f"placed-{uuid.uuid4().hex}")
        picked = self.docs.join(small(placed.withColumnRenamed("node", "doc_id"), count=2 * n_pairs), "doc_id")
        keyed = pairs.join(small(placed.withColumnRenamed("node", "a"), count=2 * n_pairs), "a")
        rows = picked.where("not big").select("group", F.col("doc_id").alias("a"), F.lit(None).cast("long").alias("b"), "text")
        rows = rows.unionByName(keyed.where("not big").select("group", "a", "b", F.lit(None).cast("string").alias("text")))
        near = rows.repartition("group").sortWithinPartitions("group").mapInArrow(_verify(self.percent), "a long, b long")
        if not placed.where("big").limit(1).count():
            return near
        sets = self.scratch.save(picked.where("big").mapInArrow(_sets, "doc_id long, shingles array<long>"), f"sets-{uuid.uuid4().hex}")
        side = lambda k: sets.select(F.col("doc_id").alias(k), F.col("shingles").alias(f"s{k}"))
        both = keyed.where("big").select("a", "b").join(side("b"), "b").join(side("a"), "a")
        both = both.select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("i"), (F.size("sa") + F.size("sb")).alias("t"))
        return near.unionByName(both.where((100 + self.percent) * F.col("i") >= self.percent * F.col("t")).select("a", "b"))


#: The same rows in DuckDB, by a join on shingles.
OP7_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(len(w) - 4), lambda i: array_to_string(w[i + 1:i + 5], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
u AS (SELECT a AS x, b AS y FROM l UNION SELECT b, a FROM l),
r(node, other) AS (SELECT x, x FROM u UNION SELECT r.node, u.y FROM r JOIN u ON u.x = r.other),
c AS (SELECT node, min(other) AS component FROM r GROUP BY 1)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component, w.doc_id) AS component_id FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON node = w.doc_id
"""


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return JaccardJoin(table(spark, sf_dir, "documents")).run()
