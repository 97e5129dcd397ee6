"""A corpus pipeline of five operators of tabloom.llm.

Each stage works on all rows that the one before it kept, is written as Parquet, and is read again. Columns beyond those of
documents pass through all stages, whatever their names; an empty table gives an empty result of each. What the stages do
with odd rows:

quality: a null or blank text has no features and is kept or not by its site alone; a null source or language is a site of
its own; each repeated row is judged on its own, and alike; long texts are read whole.
near_duplicates: null and blank texts are never near duplicates: they stay. Of each group the row with the smallest doc_id stays,
null ids last; of its equal rows one stays. Rows that share a doc_id but not a text are documents of their own.
decontamination: null and blank texts hold no item and stay; all rows of a doc_id of which a text holds an item go.
mixing: null and blank texts have no words to take and go; a null source is a source of its own; rows that share
doc_id, source and size are taken as often as they occur, on average; a document leaves when the mix takes less than half of its words.
sharding: null doc_ids share one shard; repeated rows share a shard and get slots of their own; a null text has size 1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm.common import Scratch, small, table
from tabloom.llm.decontamination import Decontaminator
from tabloom.llm.jaccard_join import JaccardJoin
from tabloom.llm.mixing import mix_sources, word_count
from tabloom.llm.quality import QualityModel
from tabloom.llm.sharding import ShardTree, assign_shards


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    model = QualityModel(docs, table(spark, sf_dir, "labels"))
    return model.score(docs).where("kept").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id."""
    scratch = Scratch(spark, "stage")
    ids = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null")
    if not ids.limit(1).count():
        found = scratch.save(JaccardJoin(docs).run(), "found")
        keep = scratch.save(found.where("doc_id = component_id").select("doc_id"), "keep")
        return docs.join(small(keep, count=scratch.rows["keep"]), "doc_id", "left_semi").select(docs.columns)
    # Ids that repeat or are missing name no row, so rows get numbers, which are written once. The documents travel in a struct, so that
    # no column of theirs can clash.
    rows = scratch.save(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("node")), "rows")
    found = scratch.save(JaccardJoin(rows.select(F.col("node").alias("doc_id"), F.col("row.text").alias("text"))).run(), "found")
    named = found.select(F.col("doc_id").alias("node"), "component_id").join(rows.select("node", F.col("row.doc_id").alias("id")), "node")
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "node")).alias("first"))
    keep = scratch.save(first.select("first.node"), "keep")
    return rows.join(small(keep, count=scratch.rows["keep"]), "node", "left_semi").select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    found = Decontaminator(docs, table(spark, sf_dir, "benchmark")).overlaps()
    ids = Scratch(spark, "stage").save(found.select(F.col("doc_id").alias("_id")).distinct(), "contaminated")
    ids = small(ids)
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["_id"]), "left_anti")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes its words, to the nearest whole number."""
    taken = mix_sources(docs).taken
    times = taken.where("size > 0").groupBy(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size")).agg(F.floor(F.sum("taken") / F.sum("size") + 0.5).cast("int").alias("_times"))
    times = small(Scratch(spark, "stage").save(times.where("_times > 0"), "times"))
    # The documents travel in a struct, so that no column of theirs can clash with the names used here. Blank ones have no
    # words to take; they share their doc_id's row at most by repetition, and stay out.
    rows = docs.where(F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")).select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    same = F.col("_row.doc_id").eqNullSafe(F.col("_id")) & F.col("_row.source").eqNullSafe(F.col("_source")) & (word_count("_row.text") == F.col("_size"))
    chosen = rows.join(times, same)
    return chosen.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("_row.*")


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with region, rack, shard, size and slot of eight shards."""
    return assign_shards(docs, ShardTree.regular(8))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: The classifier and the similarity join have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"{i}-{name}")
        scratch.keep(f"{i}-{name}")
    return docs
