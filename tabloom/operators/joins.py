"""Joins with small sides, and the folder that a cluster shares."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Narrow tables up to this many rows are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 500_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast if a bounded count shows that it is small enough."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share: that of spark.checkpoint.dir. Without one, a local master
    uses a temporary folder and any other is an error."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        current = sc._jsc.sc().getCheckpointDir()
        if current.isDefined():
            found = current.get()
        elif re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            found = tempfile.mkdtemp(prefix="tabloom-")
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{found.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read back: computed once, with its lineage cut."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
