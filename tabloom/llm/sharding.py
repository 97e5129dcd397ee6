"""Sharding by a hierarchical weighted hash tree.

A document descends from the root over regions and racks to a shard. At each node every child makes one weighted hash
draw, -ln(u) / weight with u from a hash of the key and the child's label, and the smallest draw wins. A child's
draw depends on the key and its own label and weight only, so a changed weight moves rows only into or out of the
subtrees whose weights changed: siblings keep their relative order for each row.

Null and edge cases: a null key hashes like any other value, so null keys share one shard; a null text has no bytes;
repeated rows go to one shard and get slots of their own; an empty table gives an empty result; input columns named
like the operator's own are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import columns_without, table

#: Each shard is numbered in one group for so many rows of the whole table.
SLOT_GROUP_ROWS = 8192


@dataclass(frozen=True)
class Shard:
    region: str
    rack: str
    shard: int
    weight: float = 1.0


@dataclass(frozen=True)
class ShardTree:
    """Leaves of the tree. Weights of racks and regions are the sums of the weights below them."""

    shards: tuple[Shard, ...]

    @staticmethod
    def regular(n: int, base: int = 8, racks_per_region: int = 2, shards_per_rack: int = 2) -> ShardTree:
        """The tree that the shard count alone decides: the first `base` shards fill regions of racks, and each
        later shard is a region of its own. So tree n + 1 is tree n with one more child at the root, and the new
        shard takes rows only into itself."""
        per_region = racks_per_region * shards_per_rack
        leaves = []
        for i in range(n):
            if i < base:
                leaves.append(Shard(f"g{i // per_region}", f"r{i // shards_per_rack}", i))
            else:
                leaves.append(Shard(f"x{i}", f"x{i}r", i))
        return ShardTree(tuple(leaves))

    def reweighted(self, shard: int, weight: float) -> ShardTree:
        return ShardTree(tuple(Shard(s.region, s.rack, s.shard, weight) if s.shard == shard else s for s in self.shards))

    def levels(self) -> list[dict[str, list[tuple[str, float]]]]:
        """For each level: node -> [(child, weight)], nodes named by their path."""
        if not self.shards or len({s.shard for s in self.shards}) != len(self.shards):
            raise ValueError("a tree needs shards with distinct numbers")
        if any(not s.weight > 0 for s in self.shards):
            raise ValueError("weights are above 0; leave a shard out instead of giving it no weight")
        out: list[dict[str, dict[str, float]]] = [{}, {}, {}]
        for s in self.shards:
            for level, (node, child) in enumerate((("", s.region), (s.region, f"{s.region}/{s.rack}"), (f"{s.region}/{s.rack}", f"{s.region}/{s.rack}/{s.shard}"))):
                children = out[level].setdefault(node, {})
                children[child] = children.get(child, 0.0) + s.weight
        return [{k: sorted(v.items()) for k, v in level.items()} for level in out]


def weighted_draw(key: Column, label: Column, weight: Column) -> Column:
    """Exponential draw with the weight as its rate, from 53 bits of a hash of key and label."""
    bits = F.shiftrightunsigned(F.xxhash64(key, label), 11)
    return -F.log((bits.cast("double") + F.lit(0.5)) / F.lit(float(2**53))) / weight


def descend(key: Column, tree: ShardTree) -> tuple[Column, Column, Column]:
    """Region, rack and shard columns of a key."""
    node, path = F.lit(""), []
    for level in tree.levels():
        pairs = []
        for name, children in level.items():
            pairs += [F.lit(name), F.array(*[F.struct(F.lit(c).alias("c"), F.lit(float(w)).alias("w")) for c, w in children])]
        choices = F.element_at(F.create_map(*pairs), node)
        drawn = F.transform(choices, lambda x: F.struct(weighted_draw(key, x["c"], x["w"]).alias("d"), x["c"].alias("c")))
        node = F.array_min(drawn)["c"]
        path.append(node)
    last = lambda c: F.element_at(F.split(c, "/"), -1)
    return path[0], last(path[1]), last(path[2]).cast("int")


def text_size(text: str = "text") -> Column:
    """UTF-8 bytes of a text (null: none) plus 1."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def assign_shards(docs: DataFrame, tree: ShardTree, key: str = "doc_id", size: Column | None = None) -> DataFrame:
    """docs with region, rack, shard, size (by default text_size) and slot (0, 1, ... within the shard).

    Slots are numbered in groups of a bounded size: each shard is cut by a hash of the whole row, so rows that share a key but
    not a text are spread, and the group totals (a small table) give the offsets. Rows that are equal in all columns are
    interchangeable.
    """
    region, rack, shard = descend(F.col(key), tree)
    own = ["region", "rack", "shard", "size", "slot"]
    size = text_size() if size is None else size
    n = docs.count()
    groups = max(1, -(-n // SLOT_GROUP_ROWS))
    kept = columns_without(docs, own)
    # The input's columns travel in a struct, so none of them can clash with the names used here.
    salted = docs.select(
        F.struct(*kept).alias("_row"), F.col(key).alias("_key"), F.xxhash64(F.lit("slot"), *[F.col(f"`{c}`") for c in docs.columns]).alias("_hash"),
        region.alias("region"), rack.alias("rack"), shard.alias("shard"), size.alias("size"),
    ).withColumn("_part", F.pmod(F.col("_hash"), F.lit(groups)).cast("int"))
    totals = salted.groupBy("shard", "_part").agg(F.count("*").alias("_n"))
    before = W.partitionBy("shard").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select("shard", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    order = W.partitionBy("shard", "_part").orderBy("_key", "size", "_hash")
    return (
        salted.withColumn("_rank", F.row_number().over(order))
        .join(offsets, ["shard", "_part"])
        .select("_row.*", "region", "rack", "shard", "size", (F.col("_from") + F.col("_rank") - 1).cast("long").alias("slot"))
    )


def op2_shard_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    grown = descend(F.col("doc_id"), ShardTree.regular(9))[2]
    slim = docs.select(
        "doc_id",
        F.crc32(F.coalesce(F.col("text"), F.lit(""))).cast("long").alias("text_crc32"),
        grown.alias("grown_shard"),
        text_size().alias("bytes"),
    )
    # Only the size of a text is needed, so the text itself never enters a shuffle.
    return assign_shards(slim, ShardTree.regular(8), size=F.col("bytes")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        "slot",
        "grown_shard",
        "region",
        "rack",
    )
