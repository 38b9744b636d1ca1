"""Schedules of runs: seeds, coverage, resumable positions, chunks and retries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.order import numbered


def resolved_seed(seed: int | str, indexed: bool, fallback: int = 0) -> int | str:
    """A number, or one of two named policies; indexed sources need a number."""
    if isinstance(seed, int):
        return seed
    if seed not in ("trng", "randomized"):
        raise ValueError(f"unknown seed {seed!r}")
    return fallback if indexed else seed


def check_workers(indexed: bool, workers: int, world: int) -> None:
    if indexed and workers == 0 and world > 1:
        raise ValueError("indexed sources need a worker on several ranks")


def shuffled(df: DataFrame, seed: int, epoch: int, key: str = "id") -> DataFrame:
    """Adds the epoch's order key: a range partitioning by it shuffles the corpus without a buffer."""
    return df.withColumn("order_key", F.xxhash64(F.lit(seed), F.lit(epoch), key))


def schedule(cuts: Column, hours: Column, epochs: float, steps: Column, log_every: int) -> dict[str, Column]:
    """Optimiser steps of a run and the hours that each step and each log interval cover."""
    per_step = hours / F.greatest(steps, F.lit(1))
    return {"max_steps": F.ceil(steps * epochs).cast("long"), "hours_per_step": F.round(per_step, 6), "hours_per_log": F.round(per_step * log_every, 6), "cuts": cuts}


def resumed(plan: DataFrame, done: int, world: int, workers: int, planned: tuple[int, int]) -> DataFrame:
    """Batches after the last finished one; another number of ranks or workers is refused."""
    if (world, workers) != planned:
        raise ValueError(f"the plan was made for {planned}, not {(world, workers)}")
    return plan.where(F.col("batch_idx") > done)


def coverage(emitted: DataFrame, key: str, total: int, stream: list[str]) -> DataFrame:
    """How much of a corpus the streams saw together: distinct ids, share, and ids that several streams saw."""
    per = emitted.groupBy(key).agg(F.count_distinct(*stream).alias("streams"))
    return per.agg(
        F.count("*").alias("distinct_ids"), F.round(F.count("*") / total, 6).alias("share"), F.coalesce(F.sum(F.col("streams") - 1), F.lit(0)).alias("cross_stream_duplicates")
    )


def chunked(df: DataFrame, size: int, by: list[str], order: str) -> DataFrame:
    """Fixed-size chunks within each group, in order."""
    return numbered(df, by, order, "chunk").withColumn("chunk", F.floor(F.col("chunk") / size).cast("long"))


def chunk_report(chunks: DataFrame, by: list[str], result: Column) -> DataFrame:
    """Rows and bad rows of each chunk: a row is bad where its ``result`` is null, which ``try_`` functions give instead of an error.

    A bad row fails alone, so that no chunk has to be gone through again row by row.
    """
    return chunks.groupBy(*by, "chunk").agg(F.count("*").alias("rows"), F.count_if(result.isNull()).alias("bad"))


def repeated(df: DataFrame, epochs: int, seed: int, key: str = "id") -> DataFrame:
    """``epochs`` passes over a source, each in an order of its own: the bounded form of an endless source."""
    passes = df.sparkSession.range(epochs).select(F.col("id").cast("int").alias("epoch"))
    return df.join(F.broadcast(passes)).withColumn("order_key", F.xxhash64(F.lit(seed), "epoch", key))  # a row for each pass


def evaluation_batch_size(size: int) -> int:
    """-1 stands for one record at a time."""
    if size == 0 or size < -1:
        raise ValueError("the evaluation batch size is -1 or positive")
    return 1 if size == -1 else size


def merged_positions(tokens: Column, is_audio: Column, length: Column) -> tuple[Column, Column]:
    """For one row's tokens: places after each audio token grows to its length, and the total length.

    A token's place is its own plus what earlier audio tokens added.
    """
    added = F.zip_with(is_audio, length, lambda a, n: F.when(a, n - 1).otherwise(0).cast("long"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))
    fold = F.aggregate(added, start, lambda s, x: F.struct((s["at"] + 1 + x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")))
    return fold["out"], fold["at"]
