"""Buckets, duration batches, mixture draws and partitions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def boundaries(histogram: list[tuple[float, int]], buckets: int) -> list[float]:
    """Equal-mass bucket boundaries of (duration, count) in rising order.

    A running sum restarts with each value that finds it above total / buckets; that value is the boundary.
    """
    total, n = sum(d * c for d, c in histogram), sum(c for _, c in histogram)
    if n == 0:
        raise ValueError("no durations")
    if buckets > n:
        raise ValueError("more buckets than records")
    share, run, out = total / buckets, 0.0, []
    for d, c in histogram:
        while c:
            if run > share:
                out.append(d)
                run = 0.0
            # values to add until the sum is above the share
            take = min(c, max(1, int((share - run) // d) + 1)) if d > 0 else c
            while take > 1 and run + d * (take - 1) > share:
                take -= 1
            run, c = run + d * take, c - take
    return out


def bucket_boundaries(df: DataFrame, buckets: int, resolution: float = 0.01) -> list[float]:
    """Boundaries from the duration histogram: distinct steps reach the driver, bounded by the longest duration."""
    rows = df.groupBy(F.rint(F.col("duration") / resolution).cast("long").alias("key")).count().orderBy("key").collect()
    return boundaries([(r["key"] * resolution, r["count"]) for r in rows], buckets)


def bucket_of(duration: Column, bounds: list[float]) -> Column:
    """Number of boundaries at or below the duration."""
    return F.size(F.filter(F.array(*[F.lit(float(b)) for b in bounds]), lambda b: b <= duration)) if bounds else F.lit(0)


def duration_batches(df: DataFrame, by: list[str], limit: float, batch_size: int | None = None, block: int | Column = 64, drop_last: bool = False) -> DataFrame:
    """Greedy batches of records in id order: a batch closes before the record that would pass ``limit``.

    Batches form within (by, block), so a bucket that holds any share of the rows is dealt over many tasks; blocks are
    those of the id's hash, or a column's. With ``block`` 1 a bucket is one sequence.
    """
    kind = ", ".join(f"{c} {t}" for c, t in df.dtypes)
    groups = [*by, "batch_block"]
    dealt = df.withColumn("batch_block", (F.pmod(F.xxhash64("id"), F.lit(block)) if isinstance(block, int) else block).cast("int"))

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        batch, run, n, out = 0, 0.0, 0, np.zeros(len(pdf), np.int64)
        for i, d in enumerate(pdf["duration"].to_numpy()):
            if n and (run + d > limit or batch_size and n >= batch_size):
                batch, run, n = batch + 1, 0.0, 0
            run, n, out[i] = run + d, n + 1, batch
        pdf = pdf.assign(batch=out)
        return pdf[pdf["batch"] < batch] if drop_last and batch_size and n < batch_size else pdf

    return dealt.groupBy(*groups).applyInPandas(plan, f"{kind}, batch_block int, batch long")


def draw(spark_range: DataFrame, weights: list[tuple[str, float]], seed: int = 42) -> DataFrame:
    """For each position (column ``id``) a source with probability of its weight: a hash against cumulative shares."""
    total = sum(w for _, w in weights)
    first = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))), 1, 13)  # 52 bits that any engine can repeat
    u = (F.conv(first, 16, 10).cast("double") / float(1 << 52)).alias("u")
    run, chosen = 0.0, F.lit(None).cast("string")
    steps = []
    for name, w in weights:
        run += w / total
        steps.append((run, name))
    for edge, name in reversed(steps):
        chosen = F.when(F.col("u") < edge, name).otherwise(chosen)
    return spark_range.select("id", u).select("id", F.coalesce(chosen, F.lit(weights[-1][0])).alias("source"))


def partition_of(position: Column, world: int, workers: int) -> Column:
    """Which of rank x worker streams a sample belongs to: disjoint and complete."""
    return F.pmod(position, F.lit(world * workers))


def resolved_weights(given: list[float | None], counts: list[int]) -> list[float]:
    """One level's weights: all as given, or by size where none is; a mixture of both is an error."""
    if len(given) == 1:
        return [1.0 if given[0] is None else given[0]]
    if all(w is not None for w in given):
        return list(given)
    if any(w is not None for w in given):
        raise ValueError("give every weight of a level or none")
    return [float(max(1, c)) for c in counts]


def flattened(tree: list[dict], weight: float = 1.0, path: tuple = (), tags: dict | None = None) -> Iterator[dict]:
    """Leaves of a source tree with effective weight, group path and tags (outer tags win)."""
    level = resolved_weights([e.get("weight") for e in tree], [e.get("count", 0) for e in tree])
    total = sum(level) or 1.0
    for entry, w in zip(tree, level, strict=True):
        own = {**entry.get("tags", {}), **(tags or {})}
        share = weight * w / total
        if entry.get("type") == "group":
            yield from flattened(entry["input_cfg"], share, (*path, entry.get("name", "")), own)
        else:
            yield {**entry, "effective_weight": share, "group": list(path), "tags": own}
