"""Joins of the corpus jobs: pairing, first-source lookup, pending work, overlap and multiset comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def paired(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One-to-one pairs by key; of repeated keys the smallest row of either side counts."""
    one = lambda df: df.groupBy(key).agg(*[F.min_by(c, F.struct(*[x for x in df.columns if x != key])).alias(c) for c in df.columns if c != key])
    return one(left).join(one(right), key)


def unpaired(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """How many keys each side has alone."""
    a = left.select(key).distinct().withColumn("l", F.lit(1))
    b = right.select(key).distinct().withColumn("r", F.lit(1))
    return a.join(b, key, "full_outer").agg(F.count_if(F.col("r").isNull()).alias("left_only"), F.count_if(F.col("l").isNull()).alias("right_only"))


def first_source(ids: DataFrame, manifest: DataFrame, key: str = "cut_id") -> DataFrame:
    """The source of each id, the smallest if several list it; unknown ids get null."""
    build = manifest.groupBy(key).agg(F.min("source").alias("source"))
    return ids.join(build, key, "left")


def pending(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return work.join(done.select(key), key, "left_anti")


def overlapping(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.join(b.select(key), key, "left_semi")


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Multiset comparison: rows that one side has more often."""
    return a.exceptAll(b).agg(F.count("*").alias("left_more")).crossJoin(b.exceptAll(a).agg(F.count("*").alias("right_more")))  # one row each


def with_measurements(leaves: DataFrame, cache: DataFrame) -> DataFrame:
    """Leaves with cached hours; an unmeasured leaf is SKIP, not zero."""
    return leaves.join(cache, "path", "left").withColumn("status", F.when(F.col("hours").isNull(), "SKIP").otherwise("OK"))
