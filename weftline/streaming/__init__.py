"""Structured Streaming forms of the cumulative counters and resumable result writers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def seen_hours(stream: DataFrame, key, seconds: str = "duration") -> DataFrame:
    """Cumulative hours by key; the state store is the checkpoint (output mode update or complete)."""
    return stream.groupBy(key.alias("key")).agg((F.sum(seconds) / 3600).alias("hours"))


def append_new(stream: DataFrame, path: str, checkpoint: str, key: str = "id"):
    """Appends rows whose key is not yet among the results; a restarted query resumes.

    Keys of results that are there at the start are written once beside the checkpoint; keys of this query are in its
    state, so that a micro-batch never reads what the query itself has written. A batch that was written but not
    committed before a stop is among the results at the restart.
    """
    spark = stream.sparkSession
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    known = None
    if fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path):
        known = f"{checkpoint.rstrip('/')}-known/{uuid.uuid4().hex}"
        spark.read.schema(stream.schema).json(path).select(key).distinct().write.parquet(known)

    def write(batch: DataFrame, _: int) -> None:
        new = batch if known is None else batch.join(batch.sparkSession.read.parquet(known), key, "left_anti")
        new.select(*batch.columns).write.mode("append").json(path)

    return stream.dropDuplicates([key]).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def paired(left: DataFrame, right: DataFrame, key: str, time: str, within: str = "10 minutes") -> DataFrame:
    """Stream-stream pairing by key; the watermark bounds the state, late partners are dropped."""
    a = left.withWatermark(time, within).alias("a")
    b = right.withWatermark(time, within).alias("b")
    near = F.expr(f"a.{key} = b.{key} and b.{time} between a.{time} - interval {within} and a.{time} + interval {within}")
    return a.join(b, near)


def windowed_counts(stream: DataFrame, time: str, window: str, late: str, by: list[str]) -> DataFrame:
    """Events by tumbling window under a watermark."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window), *by).agg(F.count("*").alias("n"))
