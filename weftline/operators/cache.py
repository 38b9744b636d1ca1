"""The measurement cache: which sources to read again, what a budget allows, and totals over leaves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.measure import greedy_budget

#: Seconds by which a manifest may be newer than its measurement.
SLACK = 1.0


def judged(sources: DataFrame, cache: DataFrame) -> DataFrame:
    """Sources (path, modified, shards) with their cache entry and a verdict.

    An entry counts if it holds records and a histogram, was not extrapolated from a sample, and no manifest is newer.
    """
    whole = F.col("cuts").isNotNull() & F.col("hist").isNotNull() & ~F.coalesce("sampled", F.lit(False))
    fresh = F.col("modified") <= F.col("measured") + SLACK
    verdict = F.when(~whole | F.col("measured").isNull(), "missing").when(~fresh, "stale").otherwise("reuse")
    return sources.join(cache, "path", "left").withColumn("verdict", verdict)


def to_measure(judgement: DataFrame, budget: int | None = 200) -> list[str]:
    """Paths to read now: all that are not reusable, or the cheapest that fit the shard budget. One row per source."""
    open_ = [(r["path"], r["shards"]) for r in judgement.where("verdict <> 'reuse'").select("path", "shards").collect()]
    return sorted(p for p, _ in open_) if budget is None else greedy_budget(open_, budget)


def updated(cache: DataFrame, new: DataFrame) -> DataFrame:
    """The cache with new entries in place of old ones of the same path."""
    return cache.join(new.select("path"), "path", "left_anti").unionByName(new)


def split_totals(leaves: DataFrame, cache: DataFrame) -> DataFrame:
    """Per split: hours and records over leaves (a path listed twice counts twice), distinct paths, and what is unmeasured."""
    both = leaves.join(cache.select("path", "hours", "cuts"), "path", "left")
    return both.groupBy("split").agg(
        F.round(F.coalesce(F.sum("hours"), F.lit(0.0)), 6).alias("hours"),
        F.coalesce(F.sum("cuts"), F.lit(0)).alias("cuts"),
        F.count_distinct("path").alias("paths"),
        (F.count("*") - F.count_distinct("path")).alias("duplicates"),
        F.count_if(F.col("hours").isNull()).alias("unmeasured"),
    )


def seeded(cache: DataFrame, other: DataFrame) -> DataFrame:
    """Hours taken over from another cache where this one has none; extrapolated entries are left out."""
    given = other.where(~F.coalesce("sampled", F.lit(False))).select("path", F.col("hours").alias("given"))
    return cache.join(given, "path", "full_outer").withColumn("hours", F.coalesce("hours", "given")).drop("given")
