"""Merkle dataset manifest with coordinate lookup proofs.

Rows are leaves of a tree per group; the groups' roots are leaves of one tree above them. A node has coordinates (group, level,
place), and the node table is written once. To prove rows, each leaf explodes the coordinates of the siblings that it needs, from
its place and the run length alone; they are joined to the node table, ordered, concatenated and folded.

Levels are handled in tiers of TIER. A block of leaves that meet within a tier (at most run ** TIER) climbs in one task, and its
top nodes are the leaves of the next tier, so the number of jobs grows with the logarithm of the rows over TIER. Coordinates above
the first tier are needed by all leaves of a block alike: they are looked up once for the block's top node, so no node is asked
for by more than run ** TIER leaves, and no group, however large, is gathered or hot.

Null and edge cases: a null field has an encoding of its own; a null group is a group and comes first; rows of a group with the
same or a null id are ordered by their leaves (null first), and equal rows are leaves of their own; a group of one row has its leaf
as its root; an empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, small, table

#: Levels that are climbed and looked up at a time.
TIER = 10
#: Levels that a tree can have.
MOST_LEVELS = 62


def field(value: Column) -> Column:
    """Encoding of a value that no two values share: its UTF-8 byte count, a colon, the value; `-` for null."""
    v = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))


def leaf_digest(values: Sequence[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*map(field, values)).cast("binary"), 256))


def as_hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def node_digest(digests: Sequence[bytes]) -> bytes:
    """Digest of a run of nodes: sha256 of their lowercase hex texts."""
    return hashlib.sha256(b"".join(d.hex().encode() for d in digests)).digest()


def _climb(run: int, base: int):
    """Of each block of nodes at level `base`, all nodes above them within the tier. n: leaves of the group."""

    def climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for g, n, block in zip(*(b.column(c).to_pylist() for c in ("g", "n", "block")), strict=True):
                nodes = [(x["idx"], x["digest"]) for x in block]
                level, width, out = base, -(-n // run**base), []
                while width > 1 and level < base + TIER:
                    runs: dict[int, list[bytes]] = {}
                    for at, d in nodes:
                        runs.setdefault(at // run, []).append(d)
                    nodes = [(at, node_digest(ds)) for at, ds in runs.items()]
                    level, width = level + 1, -(-width // run)
                    out += [(level, at, d) for at, d in nodes]
                if out:
                    levels, places, digests = zip(*out, strict=True)
                    yield pa.RecordBatch.from_pydict({"g": pa.array([g] * len(out), pa.string()), "n": pa.array([n] * len(out), pa.int64()), "level": pa.array(levels, pa.int32()), "idx": pa.array(places, pa.int64()), "digest": pa.array(digests, pa.binary())})

    return climb


class Tree:
    """One tree per group g over leaves (g, idx, n, digest, payload): place and number of leaves, a digest, and a struct that
    stays with the leaf."""

    def __init__(self, leaves: DataFrame, scratch: Scratch, name: str, run: int):
        if run < 2:
            raise ValueError("a run has two nodes at least")
        self.leaves, self.scratch, self.name, self.run = leaves, scratch, name, run
        self.block = run**TIER
        self.powers = [p for p in (run**k for k in range(MOST_LEVELS)) if p < 2**62]
        most, self.tiers = leaves.agg(F.max("n")).first()[0] or 1, 1
        while self.block**self.tiers < most:
            self.tiers += 1
        nodes = leaves.select("g", "n", F.lit(0).alias("level"), "idx", "digest")
        for t in range(self.tiers):
            base = t * TIER
            below = nodes.where(F.col("level") == base) if t else nodes
            block = below.groupBy("g", "n", F.expr(f"idx div {self.block}").alias("b")).agg(F.sort_array(F.collect_list(F.struct("idx", "digest"))).alias("block"))
            climbed = scratch.save(block.select("g", "n", "block").mapInArrow(_climb(run, base), "g string, n long, level int, idx long, digest binary"), f"{name}-{t}")
            nodes = nodes.unionByName(climbed)
        self.nodes = nodes

    def power(self, level: Column) -> Column:
        return F.element_at(F.array(*[F.lit(p).cast("long") for p in self.powers]), level + 1)

    def depth(self) -> Column:
        """Level of the root: the number of levels with more than one node."""
        return F.size(F.filter(F.array(*[F.lit(p).cast("long") for p in self.powers]), lambda p: p < F.col("n")))

    def roots(self) -> DataFrame:
        return self.nodes.where(F.col("level") == self.depth()).select("g", "n", "digest")

    def coordinates(self, entries: DataFrame, base: int) -> DataFrame:
        """The siblings that nodes (g, idx, n) of level `base` need within the tier: level and place sib."""
        levels = F.filter(F.sequence(F.lit(base), F.lit(base + TIER - 1)), lambda x: x < F.col("depth"))
        at = entries.select("g", "idx", "n", self.depth().alias("depth")).select("g", "idx", "n", F.explode(levels).alias("level"))
        own = at.withColumn("p", self.power(F.col("level") - base)).withColumn("own", F.expr("idx div p"))
        start = F.col("own") - F.col("own") % self.run
        width = F.expr("(n + q - 1) div q")
        run = own.withColumn("q", self.power(F.col("level"))).select("g", "idx", "level", "own", F.explode(F.sequence(start, F.least(start + self.run, width) - 1)).alias("sib"))
        return run.where("sib <> own").select("g", "idx", "level", "sib", (F.col("sib") < F.col("own")).alias("left"))

    def proofs(self, ends: DataFrame) -> DataFrame:
        """(payload, digest, path, end) of each leaf. path: from the leaf up, the digests before and after the own node in its
        run, concatenated. ends (g, n, path, end): the path from each group's root on, and what is known of the group."""
        above = None
        for t in reversed(range(self.tiers)):
            base, top = t * TIER, (t + 1) * TIER
            low, high = self.block**t, self.block ** (t + 1)
            ending = ends.where((F.col("n") <= high) & ((F.col("n") > low) | F.lit(t == 0))).select("g", F.lit(0).cast("long").alias("up"), F.col("path").alias("rest"), "end")
            above = ending if above is None else above.unionByName(ending)
            if t == 0:
                entries = self.leaves.select("g", "idx", "n", "digest", "payload")
            else:
                entries = self.nodes.where((F.col("level") == base) & (F.col("n") > low)).select("g", "idx", "n", "digest", F.lit(None).cast(self.leaves.schema["payload"].dataType).alias("payload"))
            wanted = self.nodes.where((F.col("level") >= base) & (F.col("level") < top)).select("g", "level", F.col("idx").alias("sib"), F.col("digest").alias("d"))
            found = self.coordinates(entries, base).join(wanted, ["g", "level", "sib"])
            own = F.struct("n", "digest", "payload").alias("own")
            kind = self.leaves.select(own).schema["own"].dataType
            both = found.select("g", "idx", F.struct("level", "sib", "left", "d").alias("x"), F.lit(None).cast(kind).alias("own")).unionByName(
                entries.select("g", "idx", F.lit(None).cast("struct<level: int, sib: long, left: boolean, d: binary>").alias("x"), own)
            )
            # All that belongs to a block meets by the block's place, where the block's own proof is joined as well.
            block = both.withColumn("up", F.expr(f"idx div {self.block}")).repartition("g", "up").groupBy("g", "up", "idx")
            met = block.agg(F.sort_array(F.collect_list("x")).alias("xs"), F.first("own", ignorenulls=True).alias("own"))
            met = met.select("g", "up", "idx", "xs", "own.*").withColumn("depth", self.depth())
            side = lambda level, left: F.aggregate(
                F.filter("xs", lambda x: (x["level"] == level) & (x["left"] == F.lit(left))), F.lit("").cast("binary"), lambda a, x: F.concat(a, x["d"])
            )
            levels = F.filter(F.sequence(F.lit(base), F.lit(top - 1)), lambda x: x < F.col("depth"))
            met = met.withColumn("path", F.transform(levels, lambda x: F.struct(side(x, True).alias("before"), side(x, False).alias("after"))))
            met = met.join(above, ["g", "up"]).withColumn("path", F.concat("path", "rest"))
            above = met.select("g", F.col("idx").alias("up"), F.col("path").alias("rest"), "end")
        return met.select("payload", "digest", "path", "end")


PATH = "array<struct<before: binary, after: binary>>"


class MerkleManifest:
    """Manifest of a table: leaves are rows, groups are the values of a column, and leaves of a group ascend by an id."""

    def __init__(self, docs: DataFrame, fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), id_column: str = "doc_id", group: str = "lang", run: int = 2, changed: dict[str, Column] | None = None):
        """changed: fields as they are found later, null where they are as they were; the proofs show such rows."""
        self.scratch = Scratch(docs.sparkSession, "merkle")
        now = changed or {}
        touched = F.lit(False)
        for c in now.values():
            touched = touched | c.isNotNull()
        later = F.when(touched, leaf_digest([F.coalesce(now[f], F.col(f)) if f in now else F.col(f) for f in fields]))
        # Only digests and ids leave the texts. 'n' sorts before 'v', so a null group comes first.
        slim = docs.select(
            F.coalesce(F.concat(F.lit("v"), F.col(group).cast("string")), F.lit("n")).alias("g"),
            F.col(id_column).alias("id"),
            leaf_digest([F.col(f) for f in fields]).alias("digest"),
            later.alias("changed"),
            F.monotonically_increasing_id().alias("row"),
        )
        slim = self.scratch.save(slim, "slim")
        leaves = self.numbered(slim, ["id", "digest", "row"], "leaves").select("g", "idx", "n", "digest", F.struct("id", "changed").alias("payload"))
        self.rows = Tree(leaves, self.scratch, "rows", run)
        roots = self.rows.roots().select(F.lit("all").alias("g"), F.col("g").alias("name"), F.col("n").alias("size"), "digest")
        groups = self.numbered(self.scratch.save(roots, "roots"), ["name"], "groups").select("g", "idx", "n", "digest", F.struct("name", "size").alias("payload"))
        self.groups = Tree(groups, self.scratch, "groups", run)

    def numbered(self, rows: DataFrame, order: Sequence[str], name: str) -> DataFrame:
        """rows with idx, their place in g by the order, and n, the rows of g: a range sort, counts per group and partition,
        and their running sums."""
        spread = rows.repartitionByRange("g", *order).sortWithinPartitions("g", *order)
        spread = self.scratch.save(spread.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), name)
        counts = self.scratch.save(spread.groupBy("g", "part").agg(F.min("at").alias("first"), F.count("*").alias("k")), f"{name}-counts")
        before = W.partitionBy("g").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
        shift = F.coalesce(F.sum("k").over(before), F.lit(0)) - F.col("first")
        counts = counts.select("g", "part", shift.alias("shift"), F.sum("k").over(W.partitionBy("g")).alias("n"))
        return spread.join(small(counts, count=self.scratch.rows[f"{name}-counts"]), ["g", "part"]).withColumn("idx", F.col("at") + F.col("shift"))

    def nodes(self) -> DataFrame:
        """The manifest: (tree, grp, level, place, digest) of all nodes of the rows' trees and of the tree over the groups."""
        name = F.when(F.col("g") != "n", F.expr("substring(g, 2)"))
        rows = self.rows.nodes.select(F.lit("rows").alias("tree"), name.alias("grp"), "level", F.col("idx").alias("place"), as_hex(F.col("digest")).alias("digest"))
        return rows.unionByName(self.groups.nodes.select(F.lit("groups").alias("tree"), F.lit(None).cast("string").alias("grp"), "level", F.col("idx").alias("place"), as_hex(F.col("digest")).alias("digest")))

    def proofs(self) -> DataFrame:
        """(id, leaf, subroot, root, path, folded_root, verified) of each row; path holds the siblings' digests as raw bytes."""
        whole = self.groups.roots().select("g", "n", F.array().cast(PATH).alias("path"), F.struct(F.col("digest").alias("root")).alias("end"))
        ends = self.groups.proofs(whole).select(
            F.col("payload.name").alias("g"), F.col("payload.size").alias("n"), "path", F.struct(F.col("digest").alias("subroot"), F.col("end.root").alias("root")).alias("end")
        )
        found = self.rows.proofs(ends)
        start = as_hex(F.coalesce("payload.changed", "digest"))
        step = lambda acc, x: F.sha2(F.concat(as_hex(x["before"]), acc, as_hex(x["after"])).cast("binary"), 256)
        return found.select(
            F.col("payload.id").alias("id"),
            as_hex(F.col("digest")).alias("leaf"),
            as_hex(F.col("end.subroot")).alias("subroot"),
            as_hex(F.col("end.root")).alias("root"),
            "path",
            F.aggregate("path", start, step).alias("folded_root"),
        ).withColumn("verified", F.col("folded_root") == F.col("root"))

    def close(self) -> None:
        """Drops the tables that the results read."""
        self.scratch.drop()


def proof_digest(path: str = "path") -> Column:
    """sha256 of all siblings' hex texts, level by level to the root, left to right."""
    return F.sha2(F.aggregate(path, F.lit(""), lambda acc, x: F.concat(acc, as_hex(x["before"]), as_hex(x["after"]))).cast("binary"), 256)


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    picked = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    manifest = MerkleManifest(table(spark, sf_dir, "documents"), changed={"n_chars": F.when(picked, F.col("n_chars") + 1)})
    return manifest.proofs().select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", proof_digest().alias("proof_sha256"), "folded_root", "verified")


OP13_SQL = """
with recursive d as (
  select doc_id, lang, n_chars,
    'd' || coalesce(octet_length(encode(doc_id::varchar)) || ':' || doc_id, '-') as k,
    coalesce(octet_length(encode(doc_id::varchar)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
      || coalesce(octet_length(encode(lang)) || ':' || lang, '-') as head,
    coalesce(octet_length(encode(text)) || ':' || text, '-') as tail,
    xor(list_reduce(list_prepend(4294967295::ubigint, flatten(list_transform(string_split(doc_id::varchar, ''), lambda ch: [ord(ch)::ubigint, 0, 0, 0, 0, 0, 0, 0]))),
      lambda c, b: xor(xor(c, b) >> 1, 3988292384::ubigint * (xor(c, b) & 1))), 4294967295::ubigint) as crc
  from documents),
l as (
  select doc_id, lang, coalesce('v' || lang, 'n') as g, sha256(head || coalesce(length(n_chars::varchar) || ':' || n_chars, '-') || tail) as leaf,
    case when crc % 7 = 0 and n_chars is not null then sha256(head || length((n_chars + 1)::varchar) || ':' || (n_chars + 1) || tail) end as tampered
  from d),
i as (select *, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 as idx from l),
up as (
  select g, 0 as level, idx, leaf as h, count(*) over (partition by g) as width from i
  union all
  select g, level + 1, idx // 2, sha256(string_agg(h, '' order by idx)), (any_value(width) + 1) // 2 from up where width > 1 group by g, level, idx // 2),
sub as (select g, level as depth, h as subroot, row_number() over (order by encode(g)) - 1 as idx, count(*) over () as width from up where width = 1),
top as (
  select 0 as level, idx, subroot as h, width from sub
  union all
  select level + 1, idx // 2, sha256(string_agg(h, '' order by idx)), (any_value(width) + 1) // 2 from top where width > 1 group by level, idx // 2),
steps as (
  select i.g, i.idx, u.level, case when s.idx < u.idx then s.h else '' end as before, case when s.idx > u.idx then s.h else '' end as after
  from i join up u on u.g = i.g and u.idx = i.idx // (1::bigint << u.level) and u.width > 1
  left join up s on s.g = u.g and s.level = u.level and s.idx = xor(u.idx, 1)
  union all
  select i.g, i.idx, sub.depth + u.level, case when s.idx < u.idx then s.h else '' end, case when s.idx > u.idx then s.h else '' end
  from i join sub on sub.g = i.g join top u on u.idx = sub.idx // (1::bigint << u.level) and u.width > 1
  left join top s on s.level = u.level and s.idx = xor(u.idx, 1)),
paths as (select g, idx, list({'b': before, 'a': after} order by level) as path from steps group by g, idx),
r as (
  select i.doc_id, i.leaf, sub.subroot, (select h from top where width = 1) as root, coalesce(p.path, []) as path, coalesce(i.tampered, i.leaf) as start
  from i join sub using (g) left join paths p on p.g = i.g and p.idx = i.idx)
select doc_id, leaf, subroot, root,
  sha256(list_aggregate(list_prepend('', list_transform(path, lambda x: x.b || x.a)), 'string_agg', '')) as proof_sha256,
  list_reduce(list_prepend({'b': start, 'a': ''}, path), lambda acc, x: {'b': sha256(x.b || acc.b || x.a), 'a': ''}).b as folded_root,
  list_reduce(list_prepend({'b': start, 'a': ''}, path), lambda acc, x: {'b': sha256(x.b || acc.b || x.a), 'a': ''}).b = root as verified
from r
"""
