"""Clusters by a threshold on similarity: components of the links, and each cluster's most central member."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.operators.joins import stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) with the smallest reachable node. Labels spread along edges and jump to their label's label; each
    round is stored in the shared folder, which cuts the lineage, and the end is when none changes."""
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
    e = stored(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = e.select(F.col("u").alias("node")).distinct().withColumn("component", F.col("node"))
    last = None
    while True:
        near = e.join(labels, F.col("v") == F.col("node")).groupBy("u").agg(F.min("component").alias("m"))
        low = labels.join(near, F.col("node") == F.col("u"), "left").select("node", F.least("component", F.coalesce("m", "component")).alias("component"))
        jump = low.select(F.col("node").alias("j"), F.col("component").alias("far"))
        labels = low.join(jump, F.col("component") == F.col("j"), "left").select("node", F.least("component", F.coalesce("far", "component")).alias("component"))
        labels = stored(labels, "labels")
        mark = labels.agg(F.bit_xor(F.xxhash64("node", "component"))).first()[0]
        if mark == last:
            return labels
        last = mark


def medoids(similar: DataFrame, clusters: DataFrame) -> DataFrame:
    """The member of each cluster with the greatest mean similarity to the others; ties by name."""
    both = similar.select(F.col("a").alias("node"), "score").unionByName(similar.select(F.col("b").alias("node"), "score"))
    mean = clusters.join(both.groupBy("node").agg(F.avg("score").alias("mean")), "node", "left").withColumn("mean", F.coalesce("mean", F.lit(0.0)))
    return mean.groupBy("component").agg(F.min_by("node", F.struct(-F.col("mean"), "node")).alias("medoid"), F.count("*").alias("members"))
