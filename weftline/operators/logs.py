"""Run logs: emission streams, metric histories, disjointness, prefix comparison and divergence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.operators.order import carried, numbered


def first_per_batch(df: DataFrame, order: str = "file_pos") -> DataFrame:
    """Of repeated (rank, worker, batch) entries the first."""
    place = Window.partitionBy("rank", "worker", "batch_idx").orderBy(order)
    return df.withColumn("place", F.row_number().over(place)).where(F.col("place") == 1).drop("place")


def exploded(batches: DataFrame) -> DataFrame:
    """One row per emitted id with its place in the stream's batches."""
    return batches.select("rank", "worker", "batch_idx", F.posexplode("cut_ids").alias("pos", "cut_id"))


def positions(df: DataFrame, stream: list[str], order: str) -> DataFrame:
    """Adds the place of each row in its stream, from 0."""
    return numbered(df, stream, order)


def split_position(step: int, accumulate: int, workers: int) -> int:
    """Batches of one worker before a checkpoint."""
    return step * accumulate // workers


def prefix_compare(first: DataFrame, second: DataFrame, split: int, stream: list[str], value: str) -> DataFrame:
    """Per stream: overlapping places after the split, equal ones and the first that differs."""
    a = first.where(F.col("pos") >= split).select(*stream, (F.col("pos") - split).alias("pos"), F.col(value).alias("a"))
    b = second.select(*stream, "pos", F.col(value).alias("b"))
    same = F.col("a").eqNullSafe(F.col("b"))
    return a.join(b, [*stream, "pos"]).groupBy(*stream).agg(
        F.count("*").alias("compared"), F.count_if(same).alias("equal"), F.min(F.when(~same, F.col("pos"))).alias("first_difference")
    )


def composition(df: DataFrame, stream: list[str], source: str, key: str) -> DataFrame:
    """Emitted and distinct ids by stream and source."""
    return df.groupBy(*stream, source).agg(F.count("*").alias("emitted"), F.count_distinct(key).alias("distinct_ids"))


def reach(df: DataFrame, stream: list[str], source: str, streams: int) -> DataFrame:
    """How many streams see a source, and the share of all."""
    n = F.count_distinct(*stream)
    return df.groupBy(source).agg(n.alias("streams"), F.round(100.0 * n / streams, 6).alias("share_percent"))


def overlaps(df: DataFrame, stream: Column, key: str) -> DataFrame:
    """Ids that two streams share, by pair of streams.

    Streams are few and fixed (rank x worker); an id's streams are gathered as a set of that size, so no id becomes
    all pairs of its rows.
    """
    sets = df.groupBy(key).agg(F.array_sort(F.collect_set(stream)).alias("s")).where(F.size("s") > 1)
    pairs = F.flatten(F.transform("s", lambda a, i: F.transform(F.slice("s", i + 2, F.size("s")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return sets.select(F.explode(pairs).alias("p")).groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.count("*").alias("shared"))


def divergence(a: DataFrame, b: DataFrame) -> DataFrame:
    """(step, metric, value) of two runs: greatest difference and steps that one side misses, by metric."""
    both = a.select("step", "metric", F.col("value").alias("x")).join(b.select("step", "metric", F.col("value").alias("y")), ["step", "metric"], "full_outer")
    return both.groupBy("metric").agg(
        F.round(F.max(F.abs(F.col("x") - F.col("y"))), 9).alias("max_abs"),
        F.count_if(F.col("x").isNull()).alias("missing_first"),
        F.count_if(F.col("y").isNull()).alias("missing_second"),
        F.min(F.when(F.col("x") != F.col("y"), F.col("step"))).alias("first_step"),
    )


def noise_budget(replica: Column, factor: float, tolerance: float) -> Column:
    return F.greatest(replica * factor, F.lit(tolerance))


def last_good(df: DataFrame, value: str, stream: list[str], order: str) -> DataFrame:
    """Failed (null) batches replaced by the stream's last good one; leading failures stay null."""
    return carried(df, value, stream, order)
