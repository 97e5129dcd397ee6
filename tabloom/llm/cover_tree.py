"""Near-duplicate vectors by dual traversal of cover trees.

Vectors are compared within a label by cosine; on unit vectors a cosine of c is a distance of sqrt(2 - 2c). Points are
split by nearest pivots, level by level, until each cell is small enough for a task; cells keep their centre and
covering radius. Pairs of nodes are followed down level by level; a pair is left out when the distance of the centres
exceeds both radii plus the threshold's distance, and settled if the same bound shows that all their points link. The radii of
these upper levels are measured, not halved: over all rows no net of a given radius can be chosen without gathering them.
For each pair of cells that remains, a task builds a cover tree of either (nets with halving radii, nested by assignment),
walks both trees together with the same bound, accepts node pairs whose points all link, and compares the points of the leaf
pairs that are left.

A task never gives out pairs: it counts links per vector and gives edges that span its linked sets. Equal vectors are
one point with a number of members, so copies are counted and not expanded.

Null and edge cases: vectors that are null, empty, zero, or hold null or non-finite components, and vectors with a null
label or vec_id, link with nothing; components of any size that a double holds count, tiny and huge ones alike; vectors of different lengths never link; rows with one vec_id are one node of the
link graph; extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import BROADCAST_ELEMENTS, Scratch, components, small, small_lists, table
from .jaccard_join import groups_of

#: Most points of a cell, and most parts that a node is split into at once.
CELL = 2048
FANOUT = 16
LEAF = 64
#: Cosines this near the threshold are computed again by the plain formula.
CLOSE = 1e-9
#: Points nearer than this have one direction, as far as distances between doubles can tell.
ONE_DIRECTION = 1e-6


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two that bring their largest component near 1: squares neither overflow nor vanish, and no digit is lost."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True, initial=0.0))[1])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of equally long lists as doubles."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return a.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(a), -1)


class CoverTree:
    """Nodes over a reordered array of unit vectors: first and last row, centre, covering radius, children."""

    def __init__(self, x: np.ndarray):
        self.order = np.arange(len(x))
        self.first, self.last, self.centre, self.radius, self.children = [], [], [], [], []
        self._build(x, 0, len(x), 2.0)
        self.x = x[self.order]
        self.c = x[np.array(self.centre)]
        self.r = np.array(self.radius)

    def _build(self, x: np.ndarray, a: int, b: int, radius: float) -> int:
        """Node over rows a to b of the order; its net has half the radius, then a quarter, until it splits."""
        node = len(self.first)
        rows = self.order[a:b]
        d = np.sqrt(np.maximum(0, 2 - 2 * x[rows] @ x[rows[0]]))
        self.first.append(a)
        self.last.append(b)
        self.centre.append(int(rows[0]))
        self.radius.append(float(d.max()) + 1e-12)
        self.children.append([])
        if b - a <= LEAF:
            return node
        half = min(radius, 2.0) / 2
        while half > 1e-3:
            net, nearest = self._net(x[rows], half)
            if net > 1:
                break
            half /= 2
        else:
            return node
        if net > (b - a) // 4:  # points too far apart for a net to gather them: compare them in blocks
            return node
        by = np.argsort(nearest, kind="stable")
        self.order[a:b] = rows[by]
        cuts = np.concatenate([[0], np.cumsum(np.bincount(nearest, minlength=net))]) + a
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            self.children[node].append(self._build(x, int(s), int(e), half))
        return node

    @staticmethod
    def _net(x: np.ndarray, radius: float) -> tuple[int, np.ndarray]:
        """Points at least radius apart that cover all others, and for each point the net point that covers it."""
        owner = np.full(len(x), -1)
        n, left = 0, np.arange(len(x))
        limit = 1 - radius * radius / 2
        while len(left):
            near = x[left] @ x[left[0]] >= limit
            near[0] = True
            owner[left[near]] = n
            n, left = n + 1, left[~near]
            if n > len(x) // 4:
                owner[left] = n
                return n + 1, owner
        return n, owner


def linked(a: CoverTree, b: CoverTree, cosine: float) -> Iterator[tuple[slice | np.ndarray, slice | np.ndarray, np.ndarray | None]]:
    """Row blocks of both trees and which of their pairs link; None: all."""
    reach = np.sqrt(2 - 2 * cosine)
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while len(i):
        d = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("ij,ij->i", a.c[i], b.c[j])))
        near = d <= a.r[i] + b.r[j] + reach + 1e-7
        i, j, d = i[near], j[near], d[near]
        sure = d + a.r[i] + b.r[j] < reach - 1e-7
        for s, t in zip(i[sure].tolist(), j[sure].tolist(), strict=True):
            yield slice(a.first[s], a.last[s]), slice(b.first[t], b.last[t]), None
        pairs_i, pairs_j, leaves = [], [], {}
        for s, t in zip(i[~sure].tolist(), j[~sure].tolist(), strict=True):
            down, across = a.children[s] or [s], b.children[t] or [t]
            if not a.children[s] and not b.children[t]:
                leaves.setdefault(s, []).append(t)
                continue
            pairs_i.append(np.repeat(down, len(across)))
            pairs_j.append(np.tile(across, len(down)))
        for s, ts in leaves.items():
            rows = np.concatenate([np.arange(b.first[t], b.last[t]) for t in ts])
            for part in np.array_split(rows, len(rows) * (a.last[s] - a.first[s]) // 2_000_000 + 1):
                x, y = a.x[a.first[s] : a.last[s]], b.x[part]
                cos = x @ y.T
                ok = cos >= cosine
                for p, q in zip(*np.nonzero(np.abs(cos - cosine) < CLOSE), strict=True):
                    u, v = a.raw[a.first[s] + p], b.raw[part[q]]
                    ok[p, q] = float(np.dot(u, v)) / (np.sqrt(np.dot(u, u)) * np.sqrt(np.dot(v, v))) >= cosine
                yield slice(a.first[s], a.last[s]), part, ok
        i = np.concatenate(pairs_i) if pairs_i else np.zeros(0, np.int64)
        j = np.concatenate(pairs_j) if pairs_j else np.zeros(0, np.int64)


def _tree(raw: np.ndarray) -> CoverTree:
    t = CoverTree(unit(raw))
    t.raw = scaled(raw)[t.order]
    return t


def _spread(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Gives both ends of each pair the smallest label among them, until nothing changes."""
    while len(i):
        low = np.minimum(labels[i], labels[j])
        if (labels[i] == low).all() and (labels[j] == low).all():
            return
        np.minimum.at(labels, i, low)
        np.minimum.at(labels, j, low)
        labels[:] = labels[labels]


def _join(cosine: float):
    """Link counts and spanning edges of one pair of cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups_of(batches, "pair"):
            side = g.column("side").to_numpy()
            ids, members = g.column("rep").to_numpy(), g.column("members").to_numpy()
            raw = matrix(g.column("embedding"))
            same = (side == 0).all()
            left = np.flatnonzero(side != 2)
            right = left if same else np.flatnonzero(side == 2)
            if not len(left) or not len(right):
                continue
            a = _tree(raw[left])
            b = a if same else _tree(raw[right])
            ia, ib = left[a.order], right[b.order]
            links, labels = np.zeros(len(ids), np.int64), np.arange(len(ids))
            for x, y, ok in linked(a, b, cosine):
                p, q = ia[x], ib[y]
                if ok is None:
                    links[p] += members[q].sum()
                    if not same:
                        links[q] += members[p].sum()
                    _spread(labels, np.concatenate([p, q]), np.full(len(p) + len(q), p[0]))
                    if same:
                        links[p] -= np.where(np.isin(p, q), members[p], 0)
                    continue
                i, j = np.nonzero(ok)
                i, j = p[i], q[j]
                apart = i != j
                i, j = i[apart], j[apart]
                np.add.at(links, i, members[j])
                if not same:
                    np.add.at(links, j, members[i])
                _spread(labels, i, j)
            hit = np.flatnonzero(links)
            yield pa.RecordBatch.from_pydict({"rep": ids[hit], "to": ids[labels[hit]], "links": links[hit]})

    return run


def _nearest(known: dict[str, np.ndarray] | None):
    """Number of the nearest pivot of each point's node, and the distance to it. known: unit pivots by node, if few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            node = np.array(batch.column("node").to_pylist())
            pick, dist = np.zeros(len(node), np.int32), np.zeros(len(node))
            for n in np.unique(node):
                rows = np.flatnonzero(node == n)
                x = unit(matrix(batch.column("embedding").take(pa.array(rows))))
                pivots = known[n] if known is not None else unit(matrix(batch.column("pivots")[int(rows[0])].values))
                d = np.sqrt(np.maximum(0, 2 - 2 * x @ pivots.T))
                pick[rows] = d.argmin(axis=1)
                dist[rows] = d.min(axis=1)
            child = pa.array([f"{n}.{p}" for n, p in zip(node, pick, strict=True)])
            yield pa.RecordBatch.from_pydict({"node": child, "rep": batch.column("rep"), "members": batch.column("members"), "embedding": batch.column("embedding"), "dist": dist})

    return run


def _near(reach: float):
    """Node pairs that the covering radii do not rule out, and whether they show that all points of both link. A root has
    no radius and is never ruled out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keep, sure = [], []
            for a, b, x, y, r in zip(*[batch.column(c).to_pylist() for c in ("a", "b", "ca", "cb", "r")], strict=True):
                d = 0.0
                if r is not None and a != b:
                    u, v = unit(np.array([x, y], np.float64)) if len(x) == len(y) else (np.ones(1), np.ones(1))
                    d = float(np.sqrt(max(0.0, 2 - 2 * u @ v)))
                keep.append(r is None or d <= r + reach + 1e-7)
                sure.append(r is not None and d + r < reach - 1e-7)
            out = pa.table({"a": batch.column("a"), "b": batch.column("b"), "sure": sure, "inner": batch.column("inner")})
            yield from out.filter(pa.array(keep)).to_batches()

    return run


class NearVectors:
    """Links of vectors with a cosine of at least `cosine` to another of their label."""

    def __init__(self, vectors: DataFrame, cosine: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"):
        self.spark = vectors.sparkSession
        self.scratch = Scratch(self.spark, "vectors")
        self.cosine = cosine
        # Single precision stays as it is, which halves what moves; all else is carried as doubles. Cosines are of doubles either way.
        own = vectors.schema[vector_col].dataType.elementType
        self.kind = "array<float>" if isinstance(own, FloatType) else "array<double>"
        v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(self.kind).alias("embedding"), F.col(label_col).cast("string").alias("label"))
        ok = F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("embedding", lambda x: x != 0), F.lit(False))
        self.rows = v.withColumn("valid", ok & F.col("label").isNotNull() & F.col("vec_id").isNotNull()).withColumn("h1", F.xxhash64("embedding")).withColumn("h2", F.xxhash64(F.lit(7), F.reverse("embedding")))

    def points(self) -> DataFrame:
        """Distinct vectors of a label and length: node (the root of their tree), rep (smallest vec_id), members."""
        same = self.rows.where("valid").groupBy("label", "h1", "h2").agg(F.count("*").alias("members"), F.min("vec_id").alias("rep"), F.first("embedding").alias("embedding"))
        same = self.scratch.save(same, "points")
        self.classes = same.select("label", "h1", "h2", "members", "rep")
        root = F.concat_ws("/", F.size("embedding").cast("string"), F.regexp_replace("label", r"[./]", "_"), F.hex(F.xxhash64("label")))
        return same.select(root.alias("node"), "rep", "members", "embedding", F.lit(None).cast("double").alias("dist"))

    def cells(self) -> tuple[DataFrame, DataFrame]:
        """Points by cell, and all nodes of the trees over cells: node, parent, centre, radius, members, rep.

        Half of a node's pivots come from the outer half of its radius, one of them is its farthest point, so each split
        takes something off. A node of one direction (parallel vectors) cannot be split by distance and is cut by hash."""
        points, done, s = self.points(), None, self.scratch
        sums = (F.count("*").alias("n"), F.sum("members").alias("members"), F.min("rep").alias("rep"), F.max("dist").alias("radius"))
        sizes = s.save(points.groupBy("node").agg(*sums), "sizes-0")
        none = F.lit(None).cast("array<double>").alias("centre")
        nodes = sizes.select("node", F.lit(None).cast("string").alias("parent"), none, "radius", "members", "rep")
        level = 0
        while True:
            point = ("node", "rep", "members", "embedding")
            big = sizes.where(F.col("n") > CELL)
            fits = points.join(small(sizes.where(F.col("n") <= CELL).select("node"), 100_000), "node", "left_semi").select(*point)
            done = fits if done is None else done.unionByName(fits)
            flat = big.where(F.col("radius") <= ONE_DIRECTION)
            if flat.limit(1).count():
                tile = F.concat_ws(".", "node", F.concat(F.lit("t"), F.pmod(F.xxhash64("rep"), F.ceil(F.col("n") / CELL)).cast("string")))
                tiled = s.save(points.join(small(flat.select("node", "n", F.col("radius").alias("r")), 100_000), "node").select(tile.alias("tile"), *point, "r"), f"tiles-{level}")
                done = done.unionByName(tiled.select(F.col("tile").alias("node"), *point[1:]))
                own = tiled.groupBy("tile", "node").agg(F.sum("members").alias("members"), F.min("rep").alias("rep"), F.max("r").alias("radius"))
                above = nodes.select(F.col("node").alias("parent"), "centre")
                nodes = nodes.unionByName(s.save(own.withColumnsRenamed({"node": "parent", "tile": "node"}).join(above, "parent").select("node", "parent", "centre", "radius", "members", "rep"), f"nodes-{level}-tiles"))
                big = big.where(F.col("radius").isNull() | (F.col("radius") > ONE_DIRECTION))
            if not big.limit(1).count():
                return done, nodes
            level += 1
            parts = F.least(F.lit(FANOUT), F.ceil(2 * F.col("n") / CELL))
            big = big.select("node", "n", F.col("radius").alias("r"))
            at = points.join(small(big, 100_000), "node")
            # A few more than needed by hash, then the first of them: no node is gathered.
            tip = at.where(F.col("dist") == F.col("r")).groupBy("node").agg(F.min("rep").alias("tip"))
            draw = F.pmod(F.xxhash64("rep", F.lit(level)), F.col("n"))
            outer = F.coalesce(F.col("dist") > F.col("r") / 2, F.lit(False))
            farthest = F.coalesce(F.col("rep") == F.col("tip"), F.lit(False))
            drawn = at.join(tip, "node", "left").where((draw < 4 * FANOUT) | farthest).withColumn("outer", outer)
            turn = F.row_number().over(W.partitionBy("node", "outer").orderBy(F.desc(farthest), F.xxhash64("rep", F.lit(level)), "rep"))
            first = drawn.withColumn("turn", turn).withColumn("k", F.row_number().over(W.partitionBy("node").orderBy("turn", F.desc("outer")))).where(F.col("k") <= parts)
            vec = F.col("embedding").cast("array<double>")
            pivots = s.save(first.groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", vec.alias("v")))), lambda x: x["v"]).alias("pivots")), f"pivots-{level}")
            elements = pivots.agg(F.coalesce(F.sum(F.size("pivots") * F.size(F.col("pivots")[0])), F.lit(0))).first()[0]
            known = {r["node"]: unit(np.array(r["pivots"], np.float64)) for r in pivots.collect()} if elements <= BROADCAST_ELEMENTS else None
            moving = at if known is not None else at.join(pivots, "node")
            schema = f"node string, rep long, members long, embedding {self.kind}, dist double"
            split = moving.select("node", "rep", "members", "embedding", *([] if known is not None else ["pivots"])).mapInArrow(_nearest(known), schema)
            points = s.save(split, f"split-{level}")
            sizes = s.save(points.groupBy("node").agg(*sums), f"sizes-{level}")
            centres = pivots.select("node", F.posexplode("pivots").alias("k", "centre")).select(F.concat_ws(".", "node", "k").alias("node"), F.col("node").alias("parent"), "centre")
            nodes = nodes.unionByName(s.save(centres.join(sizes, "node").select("node", "parent", "centre", (F.col("radius") + 1e-9).alias("radius"), "members", "rep"), f"nodes-{level}"))

    def cell_pairs(self, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Pairs (a <= b) of cells that may hold linked points, and of nodes all of whose points link, from the roots down.
        What a pair of nodes settles is not looked at below it, so a dense crowd is counted without comparing its points."""
        kids = nodes.where("parent is not null").select(F.col("parent").alias("p"), F.col("node").alias("child"))
        info = nodes.select("node", "centre", "radius")
        side = lambda k: small_lists(info, "centre").select(F.col("node").alias(k), F.col("centre").alias(f"c{k}"), F.col("radius").alias(f"r{k}"))
        sure = None
        rows = nodes.where("parent is null").select(F.col("node").alias("a"), F.col("node").alias("b"), F.lit(True).alias("inner"))
        level = 0
        while True:
            near = rows.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ca", "cb", (F.col("ra") + F.col("rb")).alias("r"), "inner")
            pairs = self.scratch.save(near.mapInArrow(_near(float(np.sqrt(2 - 2 * self.cosine))), "a string, b string, sure boolean, inner boolean"), f"pairs-{level}")
            settled = pairs.where("sure").select("a", "b")
            sure = settled if sure is None else sure.unionByName(settled)
            pairs = pairs.where("not sure")
            one = pairs.join(kids.withColumnsRenamed({"p": "a", "child": "a2"}), "a", "left").join(kids.withColumnsRenamed({"p": "b", "child": "b2"}), "b", "left")
            low, high = F.coalesce("a2", "a"), F.coalesce("b2", "b")
            moved = F.col("a2").isNotNull() | F.col("b2").isNotNull()
            rows = self.scratch.save(one.select(F.least(low, high).alias("a"), F.greatest(low, high).alias("b"), moved.alias("inner")).distinct(), f"down-{level}")
            if not rows.where("inner").limit(1).count():
                return rows.select("a", "b"), sure
            level += 1

    def settled(self, cells: DataFrame, nodes: DataFrame, sure: DataFrame) -> DataFrame:
        """rep, to, links of the points of node pairs all of whose points link: counts, and edges that span them."""
        about = nodes.select("node", "members", "rep")
        both = sure.join(about.withColumnsRenamed({"node": "a", "members": "ma", "rep": "pa"}), "a").join(about.withColumnsRenamed({"node": "b", "members": "mb", "rep": "pb"}), "b")
        ends = both.select(F.explode(F.when(F.col("a") == F.col("b"), F.array(F.struct("a", "mb", "pb", F.lit(1).alias("own")))).otherwise(F.array(F.struct("a", "mb", "pb", F.lit(0).alias("own")), F.struct(F.col("b").alias("a"), F.col("ma").alias("mb"), F.col("pa").alias("pb"), F.lit(0).alias("own"))))).alias("e"))
        known = ends.groupBy(F.col("e.a").alias("above")).agg(F.sum("e.mb").alias("links"), F.max("e.own").alias("own"), F.min("e.pb").alias("to"))
        known = self.scratch.save(known, "settled")
        names = F.split("node", r"\.")
        over = nodes.select("node", F.explode(F.transform(F.sequence(F.lit(1), F.size(names)), lambda i: F.array_join(F.slice(names, F.lit(1), i), "."))).alias("above"))
        mine = self.scratch.save(over.join(small(known, 100_000, self.scratch.rows["settled"]), "above").select("node", "links", "own", "to"), "settled-cells")
        each = cells.select("node", "rep", "members").join(small(mine, 100_000, self.scratch.rows["settled-cells"]), "node")
        return each.select("rep", "to", (F.col("links") - F.col("own") * F.col("members")).alias("links")).unionByName(both.select(F.col("pa").alias("rep"), F.col("pb").alias("to"), F.lit(0).cast("long").alias("links")))

    def run(self) -> DataFrame:
        """vec_id, n_links, component_id, kept of each row."""
        cells, nodes = self.cells()
        nodes = self.scratch.save(nodes, "nodes")
        pairs, sure = self.cell_pairs(nodes)
        key = F.xxhash64("a", "b")
        seats = pairs.select(key.alias("pair"), F.explode(F.when(F.col("a") == F.col("b"), F.array(F.struct(F.col("a").alias("node"), F.lit(0).alias("side")))).otherwise(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("side")), F.struct(F.col("b").alias("node"), F.lit(2).alias("side"))))).alias("s"))
        seats = self.scratch.save(seats.select("pair", "s.node", "s.side"), "seats")
        placed = cells.select("node", "rep", "members", "embedding").join(small(seats, 200_000, self.scratch.rows["seats"]), "node").drop("node")
        found = placed.repartition("pair").sortWithinPartitions("pair").mapInArrow(_join(self.cosine), "rep long, to long, links long")
        found = self.scratch.save(found.unionByName(self.settled(cells, nodes, sure)), "found")
        links = found.groupBy("rep").agg(F.sum("links").alias("others"))
        comps = components(found, Scratch(self.spark, "vectors-cc"), "rep", "to")
        self.scratch.keep("points", "found")
        named = self.rows.join(self.classes.withColumn("valid", F.lit(True)), ["valid", "label", "h1", "h2"], "left")
        out = named.join(links, "rep", "left").join(comps.withColumnRenamed("node", "rep"), "rep", "left")
        component = F.coalesce("component", "rep", "vec_id")
        return out.select("vec_id", F.coalesce(F.col("members") - 1 + F.coalesce("others", F.lit(0)), F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


#: The same rows in DuckDB, by all pairs within labels.
OP4_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id < b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
u AS (SELECT a AS x, b AS y FROM l UNION SELECT b, a FROM l),
r(node, other) AS (SELECT x, x FROM u UNION SELECT r.node, u.y FROM r JOIN u ON u.x = r.other),
c AS (SELECT node, min(other) AS component FROM r GROUP BY 1), d AS (SELECT x, count(*) AS n FROM u GROUP BY 1)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(component, vec_id) AS component_id, coalesce(component, vec_id) = vec_id AS kept FROM v LEFT JOIN c ON node = vec_id LEFT JOIN d ON x = vec_id
"""


def op4_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return NearVectors(table(spark, sf_dir, "embeddings")).run()
