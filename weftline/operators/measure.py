"""Measurement: hours, word statistics, histograms, roll-ups, shares and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.functions.text import word_count


def hours(seconds: Column) -> Column:
    return F.sum(seconds) / 3600


def statistics(df: DataFrame, sets: list[list[str]], keys: list[str]) -> DataFrame:
    """Count, sum, mean, median and sample deviation of duration for each grouping set, in one aggregation.

    The exact median needs all distinct values of a group; durations are hundredths, so these are bounded by the
    longest duration, not by the rows.
    """
    out = df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(k) for k in keys]).agg(
        F.count("*").alias("num_cuts"),
        F.round(F.coalesce(F.sum("duration"), F.lit(0.0)), 6).alias("total_seconds"),
        F.round(F.coalesce(F.avg("duration"), F.lit(0.0)), 6).alias("mean_seconds"),
        F.round(F.coalesce(F.median("duration"), F.lit(0.0)), 6).alias("median_seconds"),
        F.round(F.coalesce(F.stddev_samp("duration"), F.lit(0.0)), 6).alias("stdev_seconds"),
        F.grouping_id().cast("long").alias("level"),
    )
    return out


def word_statistics(df: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """Words, records with text, and the median of positive word counts by group."""
    counted = df.withColumn("n_words", word_count(F.col(text)))
    some = F.when(F.col("n_words") > 0, F.col("n_words"))
    return counted.groupBy(*by).agg(
        F.count("*").alias("num_cuts"),
        F.sum("n_words").alias("total_words"),
        F.count(some).alias("cuts_with_text"),
        F.round(F.median(some).cast("double"), 6).alias("median_words"),
    )


def length_statistics(df: DataFrame, sets: list[list[str]], keys: list[str]) -> DataFrame:
    """Mean duration and word count with their median and deviation for each grouping set; '' stands for all.

    ``df`` has duration and n_words. A deviation of fewer than two rows is 0.
    """
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    out = df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(k) for k in keys]).agg(
        F.count("*").alias("num_cuts"),
        zero(F.sum("duration") / 3600).alias("hours"),
        zero(F.avg("duration")).alias("mean_seconds"),
        F.coalesce(F.sum("n_words"), F.lit(0)).alias("total_words"),
        zero(F.avg("n_words")).alias("mean_words"),
        zero(F.median("n_words").cast("double")).alias("median_words"),
        zero(F.stddev_samp("n_words")).alias("stdev_words"),
        F.grouping_id().cast("long").alias("level"),
    )
    return out.select(*[F.coalesce(k, F.lit("")).alias(k) for k in keys], *out.columns[len(keys) :])


def keyed_statistics(df: DataFrame, source: list[str]) -> DataFrame:
    """Records and hours by task, language, language variant, pair and base pair; hours are rounded by source first."""
    from weftline.functions.languages import base_language

    hours = F.floor(F.round(F.sum("duration") * 100) / 36 + 0.5) / 10_000  # four places from hundredths of a second
    each = df.groupBy(*source, "task", "lang", "src_lang", "tgt_lang").agg(F.count("*").alias("num_cuts"), hours.alias("hours"))
    src, tgt = F.coalesce("src_lang", F.lit("en")), F.coalesce("tgt_lang", "lang", F.lit("unknown"))
    pair = lambda a, b: F.concat(a, F.lit("->"), b)
    kind = lambda name, key: F.struct(F.lit(name).alias("kind"), key.alias("key"))
    task = kind("task", F.coalesce("task", F.lit("unknown")))
    two = F.array(task, kind("pair", pair(src, tgt)), kind("base_pair", pair(base_language(src), base_language(tgt))))
    lang = F.coalesce("lang", F.lit("unknown"))
    one = F.array(task, kind("variant", lang), kind("language", base_language(lang)))
    keyed = each.select(F.explode(F.when(F.col("task") == "st", two).otherwise(one)).alias("k"), "num_cuts", "hours")
    return keyed.groupBy("k.kind", "k.key").agg(F.sum("num_cuts").alias("num_cuts"), F.round(F.sum("hours"), 4).alias("hours"))


def histogram(df: DataFrame, value: Column, by: list[str], resolution: float = 0.01) -> DataFrame:
    """Counts by half-even rounded step; mergeable by key."""
    return df.groupBy(*by, F.rint(value / resolution).cast("long").alias("key")).agg(F.count("*").alias("n"))


def merged(histograms: DataFrame, by: list[str]) -> DataFrame:
    return histograms.groupBy(*by, "key").agg(F.sum("n").alias("n"))


def percentile(histograms: DataFrame, share: float, by: list[str], resolution: float = 0.01) -> DataFrame:
    """First step that reaches ``share`` of the count, and the longest; a window over the steps only."""
    run = Window.partitionBy(*by).orderBy("key") if by else Window.partitionBy(F.lit(0)).orderBy("key")
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    cum = histograms.withColumn("cum", F.sum("n").over(run)).withColumn("total", F.sum("n").over(whole))
    return cum.groupBy(*by).agg(
        F.round(F.min(F.when(F.col("cum") >= share * F.col("total"), F.col("key"))) * resolution, 6).alias("at_share"),
        F.round(F.max("key") * resolution, 6).alias("longest"),
    )


def extrapolated_hours(df: DataFrame, by: list[str], shard: str, seconds: str, first: int) -> DataFrame:
    """Hours from each group's first shards, scaled by all shards over those read."""
    shards = df.groupBy(*by, shard).agg(F.sum(seconds).alias("seconds"))
    place = Window.partitionBy(*by).orderBy(shard)
    ranked = shards.withColumn("place", F.row_number().over(place))
    return ranked.groupBy(*by).agg(
        F.round(F.sum(F.when(F.col("place") <= first, F.col("seconds"))) / 3600 * F.count("*") / F.sum((F.col("place") <= first).cast("long")), 6).alias("hours"),
        F.count("*").alias("shards"),
    )


def two_tier_weights(sources: DataFrame, alpha: float, beta: float) -> DataFrame:
    """(lang_key, source, hours) with p_c in its language, p_l of the language and p_cl; zero hours weigh nothing."""
    lang = Window.partitionBy("lang_key")
    s = sources.withColumn("n_l", F.sum("hours").over(lang)).withColumn("k", F.count("*").over(lang))
    s = s.withColumn("w_c", F.when(F.col("hours") > 0, F.pow(F.col("hours") / F.col("n_l"), alpha)).otherwise(0.0))
    s = s.withColumn("p_c", F.when(F.col("n_l") > 0, F.col("w_c") / F.sum("w_c").over(lang)).otherwise(1.0 / F.col("k")))
    langs = sources.groupBy("lang_key").agg(F.sum("hours").alias("n"))
    total = langs.agg(F.sum("n").alias("n_all"))
    langs = langs.crossJoin(F.broadcast(total))  # one row
    langs = langs.withColumn("w_l", F.when(F.col("n") > 0, F.pow(F.col("n") / F.col("n_all"), beta)).otherwise(0.0))
    whole = langs.agg(F.sum("w_l").alias("w_all"))
    langs = langs.crossJoin(F.broadcast(whole)).select("lang_key", "n_all", (F.col("w_l") / F.col("w_all")).alias("p_l"))
    out = s.join(langs, "lang_key")
    share = F.col("hours") / F.col("n_all")
    return out.select(
        "lang_key", "source", F.round("hours", 6).alias("hours"), F.round("p_c", 9).alias("p_c"), F.round("p_l", 9).alias("p_l"),
        F.round(F.col("p_c") * F.col("p_l"), 9).alias("p_cl"), F.round(share, 9).alias("share"),
        F.when(share > 0, F.round(F.col("p_c") * F.col("p_l") / share, 6)).otherwise(float("inf")).alias("boost"),
    )


def matched_ceiling(have: DataFrame, shares: DataFrame) -> DataFrame:
    """Largest total whose shares every corpus can fill, and what each corpus then needs or lacks."""
    both = shares.join(have, "corpus", "left").withColumn("hours", F.coalesce("hours", F.lit(0.0)))
    ceiling = both.where("share > 0").agg(F.min(F.col("hours") / F.col("share")).alias("ceiling"))
    return both.crossJoin(F.broadcast(ceiling)).select("corpus", F.round("ceiling", 6).alias("ceiling"), F.round(F.col("ceiling") * F.col("share"), 6).alias("need"), F.round("hours", 6).alias("have"))  # one row


def budgeted(groups: DataFrame, budget: float) -> DataFrame:
    """asr takes the whole budget, st no more than there is."""
    return groups.withColumn("used", F.when(F.col("task") == "asr", F.lit(budget)).otherwise(F.least(F.lit(budget), F.col("hours"))))


def seen_hours(df: DataFrame, key: Column, seconds: str = "duration") -> DataFrame:
    """Hours by key and in total."""
    return df.rollup(key.alias("key")).agg(F.round(F.sum(seconds) / 3600, 6).alias("hours")).withColumn("key", F.coalesce("key", F.lit("total")))


def score_ranges(df: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    """Least and greatest score, count, missing, and the factor that would bring the range into [0, 1]."""
    top = F.max(score)
    factor = F.when(top <= 1, 1.0).when(top <= 100, 100.0).otherwise(top)
    return df.groupBy(*by).agg(F.min(score).alias("low"), top.alias("high"), F.count(score).alias("scores"), F.count_if(F.col(score).isNull()).alias("missing"), factor.alias("factor"))


def majority(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """The most frequent value of each group (ties: smallest) and how many rows differ."""
    n = df.groupBy(*by, value).agg(F.count("*").alias("n"))
    best = n.groupBy(*by).agg(F.min_by(value, F.struct(-F.col("n"), F.col(value))).alias("majority"), F.max("n").alias("agree"), F.sum("n").alias("rows"))
    return best.withColumn("outliers", F.col("rows") - F.col("agree"))


def coverage_risk(shards: DataFrame, partitions: int) -> DataFrame:
    """Shards per partition of each source, weighted too, with a verdict."""
    per = F.col("shards") / partitions
    verdict = F.when(per < 0.5, "very low").when(per < 1, "low").otherwise("ok")
    return shards.withColumn("per_partition", F.round(per, 6)).withColumn("verdict", verdict)


def greedy_budget(sources: list[tuple[str, int]], budget: int) -> list[str]:
    """Cheapest first; a source is taken if it still fits, misses are passed over. For source lists on the driver."""
    taken, left = [], budget
    for name, cost in sorted(sources, key=lambda s: (s[1], s[0])):
        if cost <= left:
            taken.append(name)
            left -= cost
    return taken
