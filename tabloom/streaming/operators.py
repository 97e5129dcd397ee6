"""Streams: tumbling counts with late rows set aside, de-duplication, metering, token buckets, gapless numbers.

State is keyed and has an end: watermarks for counts and de-duplication, a time to live for buckets."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def tumbling_counts(stream: DataFrame, ts: str, key: str, size: str = "1 day", late: str = "2 days") -> DataFrame:
    """Rows per window and key; a window is final once the watermark passes its end."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, size), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")


def first_seen(stream: DataFrame, keys: list[str], ts: str, late: str = "2 days") -> DataFrame:
    """The first row of each key within the watermark."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def split_at_lock(df: DataFrame, ts: str, lock) -> tuple[DataFrame, DataFrame]:
    """Rows up to the data lock point, and those after it, which are shown and not counted."""
    at = F.col(ts) <= F.lit(lock).cast("timestamp_ntz")
    return df.where(at), df.where(~F.coalesce(at, F.lit(False)))


def metered(calls: DataFrame, rates: DataFrame, model: str = "model") -> DataFrame:
    """Calls with their price in micro-dollars; a model without a rate has none, and is counted as unpriced elsewhere."""
    from tabloom.functions.values import cost_micro_usd
    from tabloom.operators.joins import small

    r = small(rates.select(F.col("model").alias("_m"), "rate_in", "rate_out"))
    return calls.join(r, F.col(model) == F.col("_m"), "left").withColumn("cost_micro_usd", cost_micro_usd(F.col("input_tokens"), F.col("output_tokens"), F.col("rate_in"), F.col("rate_out"))).drop("_m")


def metered_by_date(calls: DataFrame, rates: DataFrame, ts: str, model: str = "model") -> DataFrame:
    """Calls with the rate that was valid at their time (rates: model, valid_from, rate_in, rate_out) and their price in micro-dollars.

    A rate is valid until the next one of its model, so the as-of look-up is an equi-join with a bounded interval: rates are few and are
    broadcast behind a count, calls are neither sorted nor moved, and the same plan runs on a stream. Calls before the first rate, with
    a model or time that is null or a model without rates have no price. Two rates of one moment: the larger pair counts."""
    from tabloom.functions.values import cost_micro_usd
    from tabloom.operators.joins import small

    known = rates.groupBy("model", "valid_from").agg(F.max(F.struct("rate_in", "rate_out")).alias("rate"))
    until = F.lead("valid_from").over(W.partitionBy("model").orderBy("valid_from"))
    known = known.select(F.col("model").alias("_m"), F.col("valid_from").alias("_from"), until.alias("_until"), F.col("rate.rate_in").alias("rate_in"), F.col("rate.rate_out").alias("rate_out"))
    at = F.col(ts)
    j = calls.join(small(known), (F.col(model) == F.col("_m")) & (at >= F.col("_from")) & (F.col("_until").isNull() | (at < F.col("_until"))), "left")
    return j.withColumn("cost_micro_usd", cost_micro_usd(F.col("input_tokens"), F.col("output_tokens"), F.col("rate_in"), F.col("rate_out"))).drop("_m", "_from", "_until")


class TokenBucket(StatefulProcessor):
    """Admits a request if its key's bucket holds a token; buckets refill with time and forget after ttl_ms."""

    def __init__(self, capacity: float, per_second: float, ttl_ms: int = 3_600_000):
        self.capacity, self.per_second, self.ttl_ms = capacity, per_second, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.bucket = handle.getValueState("bucket", "tokens double, at double", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        tokens, at = self.bucket.get() if self.bucket.exists() else (self.capacity, None)
        # All rows of a key in a batch are ordered by time; a batch holds a bounded stretch of the stream.
        for r in pd.concat(list(rows)).sort_values("seconds").itertuples():
            tokens, allowed, at = admit(tokens, at, float(r.seconds), self.capacity, self.per_second)
            yield pd.DataFrame({"key": [key[0]], "seconds": [float(r.seconds)], "allowed": [allowed]})
        self.bucket.update((tokens, at))

    def close(self) -> None:
        pass


def admit(tokens: float, at: float | None, now: float, capacity: float, per_second: float) -> tuple[float, bool, float]:
    """Tokens left, whether the request passes, and the time of the state."""
    if at is not None:
        tokens = min(capacity, tokens + max(0.0, now - at) * per_second)
        now = max(now, at)
    return (tokens - 1, True, now) if tokens >= 1 else (tokens, False, now)


def rate_limited(stream: DataFrame, key: str, capacity: float, per_second: float) -> DataFrame:
    """key, seconds, allowed for each request; needs the RocksDB state store."""
    return stream.select(F.col(key).cast("string").alias("key"), F.col("seconds").cast("double")).groupBy("key").transformWithStateInPandas(TokenBucket(capacity, per_second), "key string, seconds double, allowed boolean", "Append", "ProcessingTime")


def numbered(batch: DataFrame, last: dict[str, int], tenant: str, order: list) -> DataFrame:
    """Numbers for the rows of one micro-batch, after the last number of each tenant: for foreachBatch with one writer."""
    from tabloom.operators.lifecycle import gapless

    known = F.create_map(*[F.lit(x) for kv in last.items() for x in kv]) if last else None
    base = F.coalesce(F.element_at(known, F.col(tenant)), F.lit(0)) if known is not None else F.lit(0)
    return gapless(batch, tenant, order).withColumn("number", F.col("number") + base)
