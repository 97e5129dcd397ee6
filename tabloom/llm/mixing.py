"""Mixing sources to target weights by a low-discrepancy schedule.

Every source is a stream of its documents in shuffled order, cut into blocks of equal token counts. A schedule of slots
maps the points of a golden-ratio sequence through the cumulative slot weights of the sources, so each stretch of
the schedule holds nearly its share of each source. The slots of one source are ranked; rank r takes block r mod
(blocks of the source), so a source with a target above its size is repeated evenly. All steps are DataFrame functions.

Null and edge cases: a null source is a source of its own, ordered last; a null, empty or blank text has size 0 and is
never taken; repeated rows are separate documents; an empty table gives an empty mix; more columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD_PATTERN, Scratch, table

#: 2^31 and the odd integer nearest to 2^31 divided by the golden ratio. Point k is k * STEP mod SPAN.
SPAN = 2147483648
STEP = 1327217885
#: Cells of the grid that turns the look-up of a point's interval into an equi-join.
CELLS = 4096


@dataclass
class Mix:
    documents: DataFrame  # doc_id, source, size, sx (source number), pos (offset in its source's stream), more columns
    sources: DataFrame  # sx, source, source_size, weight, target, block, n_blocks
    schedule: DataFrame  # slot, sx, rank, epoch, block_no
    spans: DataFrame  # slot, sx, pos, from_word, to_word: what each slot takes of each document
    taken: DataFrame  # documents with source_size, target and taken


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """sx, source, source_size, weight, target: shares of the whole by weight, each at most cap times its source.

    Resharing the excess until no source is above its cap ends at min(cap_i, level * w_i); with the sources in order of
    cap_i / w_i the level is found at the first source that stays below its own cap. One row per source."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    number = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.col("sx") % len(weights) + 1).cast("int"))
    s = by_source.withColumn("sx", number).withColumn("weight", w).withColumn("ratio", F.col("source_size") * cap / F.col("weight"))
    every = W.partitionBy(F.lit(0))
    before = every.orderBy("ratio", "sx").rowsBetween(W.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum(F.col("source_size") * cap).over(before), F.lit(0))
    level = left / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    s = s.withColumn("level", level).withColumn("open", F.col("level") <= F.col("ratio"))
    final = F.min(F.when(F.col("open"), F.struct("ratio", "sx", "level"))).over(every)
    return s.withColumn("at", final).select(
        "sx",
        "source",
        "source_size",
        "weight",
        F.when(F.struct("ratio", "sx") < F.struct(F.col("at.ratio").alias("ratio"), F.col("at.sx").alias("sx")), (F.col("source_size") * cap).cast("double"))
        .otherwise(F.col("weight") * F.col("at.level"))
        .alias("target"),
    )


def mix_sources(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    cap: int = 3,
    block_tokens: int = 4096,
    least_blocks: int = 256,
    seed: str = "mix",
    id_col: str = "doc_id",
    source_col: str = "source",
    size: Column | None = None,
) -> Mix:
    """Plan a mix of whole sources. Blocks hold block_tokens tokens; sources too small for least_blocks such blocks get
    smaller ones, so that one slot more or less is a small part of any source's target."""
    scratch = Scratch(docs.sparkSession, "mix")
    sizes = scratch.save(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), (word_count() if size is None else size).alias("size")), "sizes")
    n = sizes.count()

    s = source_targets(sizes, weights, cap)
    block = F.greatest(F.lit(1), F.least(F.lit(block_tokens), F.floor(F.col("source_size") / least_blocks))).cast("long")
    s = s.withColumn("block", block).withColumn("n_blocks", F.ceil(F.col("source_size") / F.col("block")).cast("long"))
    # Slots that a source needs, in thousandths: its target in blocks of its mean block size. Whole numbers add up alike
    # in any order.
    s = s.withColumn("need", F.when(F.col("source_size") > 0, F.ceil(F.col("target") * F.col("n_blocks") / F.col("source_size") * 1000)).otherwise(F.lit(0)).cast("long"))
    sources = scratch.save(s, "sources")

    total = int(sources.agg(F.sum("need")).first()[0] or 0)
    n_slots = -(-total // 1000)
    upto = F.sum("need").over(W.partitionBy(F.lit(0)).orderBy("sx").rowsBetween(W.unboundedPreceding, 0))
    bound = lambda x: F.floor(x / F.lit(float(total or 1)) * SPAN).cast("long")
    parts = sources.withColumn("hi", F.least(bound(upto), F.lit(SPAN))).withColumn("lo", F.coalesce(F.lag("hi").over(W.partitionBy(F.lit(0)).orderBy("sx")), F.lit(0)))
    last = F.max(F.when(F.col("need") > 0, F.col("sx"))).over(W.partitionBy(F.lit(0)))
    parts = parts.withColumn("hi", F.when(F.col("sx") == last, F.lit(SPAN)).otherwise(F.col("hi"))).where("hi > lo and need > 0")
    width = SPAN // CELLS
    cells = parts.select("sx", "lo", "hi", "n_blocks", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))).alias("cell"))
    points = docs.sparkSession.range(n_slots).select(F.col("id").alias("slot"), ((F.col("id") % SPAN) * STEP % SPAN).alias("x"))
    placed = points.withColumn("cell", F.floor(F.col("x") / width)).join(cells, "cell").where("x >= lo and x < hi")

    # Rank of a slot among those of its source, numbered in stretches of the schedule.
    stretch = max(512, math.isqrt(n_slots))
    placed = placed.select("slot", "sx", "n_blocks", F.floor(F.col("slot") / stretch).alias("at"))
    counts = placed.groupBy("sx", "at").agg(F.count("*").alias("n"))
    offset = counts.select("sx", "at", F.coalesce(F.sum("n").over(W.partitionBy("sx").orderBy("at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("from"))
    ranked = placed.withColumn("r", F.row_number().over(W.partitionBy("sx", "at").orderBy("slot"))).join(offset, ["sx", "at"])
    schedule = (
        ranked.withColumn("rank", (F.col("from") + F.col("r") - 1).cast("long"))
        .withColumn("epoch", F.floor(F.col("rank") / F.col("n_blocks")))
        .where(F.col("epoch") < cap)
        .select("slot", "sx", "rank", "epoch", (F.col("rank") % F.col("n_blocks")).alias("block_no"))
    )

    # Shuffled streams: order by hash, offsets by running sums within groups that share the hash's first digits.
    digits = max(1, math.ceil(math.log(max(1, n / 2000), 16)))
    h = F.md5(F.concat(F.lit(seed), F.lit(":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    keyed = sizes.join(sources.select("sx", "source", "source_size", "target", "block"), sizes["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    keyed = keyed.withColumn("h", h).withColumn("group", F.substring("h", 1, digits))
    totals = keyed.groupBy("sx", "group").agg(F.sum("size").alias("n"))
    starts = totals.select("sx", "group", F.coalesce(F.sum("n").over(W.partitionBy("sx").orderBy("group").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    within = W.partitionBy("sx", "group").orderBy("h", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    streams = keyed.withColumn("pos", F.coalesce(F.sum("size").over(within), F.lit(0))).join(starts, ["sx", "group"]).withColumn("pos", F.col("pos") + F.col("start"))
    streams = scratch.save(streams.select("doc_id", "source", "size", "sx", "source_size", "target", "block", "pos"), "streams")
    scratch.keep("sources", "streams")

    pieces = (
        streams.where("size > 0")
        .withColumn("block_no", F.explode(F.sequence(F.floor(F.col("pos") / F.col("block")), F.floor((F.col("pos") + F.col("size") - 1) / F.col("block")))))
        .select(
            "sx",
            "pos",
            "block_no",
            (F.greatest("pos", F.col("block_no") * F.col("block")) - F.col("pos")).alias("from_word"),
            (F.least(F.col("pos") + F.col("size"), (F.col("block_no") + 1) * F.col("block")) - F.col("pos")).alias("to_word"),
        )
    )
    spans = schedule.join(pieces, ["sx", "block_no"]).select("slot", "sx", "pos", "from_word", "to_word")
    sums = spans.groupBy("sx", "pos").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"))
    full = streams.where("size > 0").join(sums, ["sx", "pos"], "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))
    none = streams.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
    cols = ["doc_id", "source", "size", "source_size", "target", "taken", "sx", "pos"]
    return Mix(streams, sources, schedule, spans, full.select(*cols).unionByName(none.select(*cols)))


#: The same mix in DuckDB.
OP9_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sx FROM d GROUP BY source),
s1 AS (SELECT *, [5, 2, 1][sx % 3 + 1] AS weight FROM s0), s2 AS (SELECT *, source_size * 3 / weight AS ratio FROM s1),
s3 AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(source_size * 3) OVER (ORDER BY ratio, sx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT
  / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY ratio, sx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS level FROM s2),
first_open AS (SELECT ratio AS r, sx AS x, level AS l FROM s3 WHERE level <= ratio ORDER BY ratio, sx LIMIT 1),
s4 AS (SELECT sx, source, source_size, CASE WHEN (ratio, sx) < (r, x) THEN (source_size * 3)::DOUBLE ELSE weight * l END AS target, greatest(1, least(4096, source_size // 256))::BIGINT AS block FROM s3, first_open),
s5 AS (SELECT *, ceil(source_size / block)::BIGINT AS n_blocks FROM s4),
s6 AS (SELECT *, CASE WHEN source_size > 0 THEN ceil(target * n_blocks / source_size * 1000) ELSE 0 END::BIGINT AS need FROM s5),
t AS (SELECT sum(need)::BIGINT AS total FROM s6), s7 AS (SELECT *, least(floor((sum(need) OVER (ORDER BY sx))::DOUBLE / total::DOUBLE * {SPAN})::BIGINT, {SPAN}) AS h FROM s6, t),
s8 AS (SELECT *, coalesce(lag(h) OVER (ORDER BY sx), 0) AS lo, CASE WHEN sx = (SELECT max(sx) FROM s6 WHERE need > 0) THEN {SPAN} ELSE h END AS hi FROM s7),
k AS (SELECT unnest(range(0, CAST((total + 999) // 1000 AS BIGINT))) AS slot FROM t), p AS (SELECT slot, ((slot % {SPAN}) * {STEP}) % {SPAN} AS x FROM k),
q AS (SELECT sx, n_blocks, row_number() OVER (PARTITION BY sx ORDER BY slot) - 1 AS rank FROM p JOIN s8 ON x >= lo AND x < hi AND need > 0),
u AS (SELECT sx, rank % n_blocks AS b, count(*) AS times FROM q WHERE rank // n_blocks < 3 GROUP BY 1, 2),
v AS (SELECT rid, doc_id, d.source, size, source_size, target, sx, block, coalesce(sum(size) OVER (PARTITION BY sx ORDER BY md5('mix:' || coalesce(doc_id::VARCHAR, '')), doc_id, size, rid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM d JOIN s6 ON d.source IS NOT DISTINCT FROM s6.source),
w AS (SELECT rid, sx, block, pos, size, unnest(range(pos // block, (pos + size - 1) // block + 1)) AS b FROM v WHERE size > 0),
x AS (SELECT rid, sum((least(pos + size, (w.b + 1) * block) - greatest(pos, w.b * block)) * times)::BIGINT AS taken FROM w JOIN u ON u.sx = w.sx AND u.b = w.b GROUP BY 1)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken, source FROM v LEFT JOIN x USING (rid)
"""


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix_sources(docs).taken.select("doc_id", "size", "source_size", "target", "taken", "source")
