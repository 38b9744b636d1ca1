"""The record table and its filters, tags, text resolution, samples and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.functions.text import stripped, word_count


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test tables as records: id, duration (15 characters a second), text, lang, corpus, task, num_tokens, score."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return d.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("id"),
        F.round(F.col("n_chars").cast("double") / 15, 2).alias("duration"),
        "text",
        "lang",
        F.col("source").alias("corpus"),
        F.when(F.col("doc_id") % 4 == 0, "st").otherwise("asr").alias("task"),
        F.when(F.col("lang") == "en", "de").otherwise("en").alias("tgt_lang"),
        F.when(F.col("doc_id") % 10 != 0, word_count(F.col("text"))).alias("num_tokens"),
        (F.col("quality").cast("double") * 100).alias("score"),
    )


def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records' cheap columns only: the scan reads neither text nor labels."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select(
        F.col("doc_id").alias("id"),
        F.round(F.col("n_chars").cast("double") / 15, 2).alias("duration"),
        "lang",
        F.col("source").alias("corpus"),
        F.when(F.col("doc_id") % 4 == 0, "st").otherwise("asr").alias("task"),
        F.when(F.col("lang") == "en", "de").otherwise("en").alias("tgt_lang"),
    )


def within_duration(df: DataFrame, low: float | None = None, high: float | None = None, missing: str = "zero") -> DataFrame:
    """Inclusive bounds, null is open; a missing duration counts as 0, or is skipped."""
    d = F.coalesce("duration", F.lit(0.0)) if missing == "zero" else F.col("duration")
    df = df if missing == "zero" else df.where(d.isNotNull())
    df = df if low is None else df.where(d >= low)
    return df if high is None else df.where(d <= high)


def train_token_filter(df: DataFrame, max_tokens: int | None, max_rate: float | None) -> DataFrame:
    """Unknown counts stay; others within ``max_tokens`` and, for positive durations, ``max_rate`` tokens a second."""
    n, d, keep = F.col("num_tokens"), F.col("duration"), F.lit(True)
    if max_tokens is not None:
        keep = keep & (n <= max_tokens)
    if max_rate is not None:
        keep = keep & ~((d > 0) & (n / d > max_rate))
    return df.where(n.isNull() | keep)


def eval_token_filter(df: DataFrame, max_tokens: int | None, max_rate: float | None) -> DataFrame:
    """Missing counts are 0; the rate holds only when positive, over a duration of 1e-6 at least."""
    n, d, keep = F.coalesce("num_tokens", F.lit(0)), F.col("duration"), F.lit(True)
    if max_tokens is not None:
        keep = keep & (n <= max_tokens)
    if max_rate:
        keep = keep & (n / F.greatest(d, F.lit(1e-6)) <= max_rate)
    return df.where(keep)


def merged_tags(own: Column, new: Column) -> Column:
    """New tags win over a record's own; keys that only one side has stay."""
    empty = F.create_map().cast("map<string,string>")
    own, new = F.coalesce(own, empty), F.coalesce(new, empty)
    return F.map_concat(F.map_filter(own, lambda k, _: ~F.map_contains_key(new, k)), new)


def usable(text: Column) -> Column:
    """Stripped text, null where nothing is left."""
    return F.nullif(stripped(text), F.lit(""))


def resolved_text(custom: Column, path: str | None, fallback: Column, strict: bool = False) -> Column:
    """Text of a record by field.

    A field is read by dotted path, then as one key. Strict: null or blank gives null. Otherwise only a missing field
    falls back; a blank one ends as null.
    """
    if path in (None, "", "text"):
        return usable(fallback)
    found = F.coalesce(F.get_json_object(custom, "$." + path), F.get_json_object(custom, f"$['{path}']"))
    blank = usable(found)
    return blank if strict else F.when(found.isNotNull(), blank).otherwise(usable(fallback))


def valid(df: DataFrame, text: Column, audio: Column | None = None) -> DataFrame:
    """Records with some text and, where given, with audio that could be read."""
    keep = usable(text).isNotNull()
    return df.where(keep if audio is None else keep & audio.isNotNull())


def strict_violations(df: DataFrame, custom: Column, path: str, fallback: Column) -> DataFrame:
    """Rows whose field is null or blank although a fallback exists."""
    return df.where(resolved_text(custom, path, fallback, strict=True).isNull() & usable(fallback).isNotNull())


def spoken_language(tags: Column, first: Column, task: Column) -> Column:
    """Language of a record: the tag, else the first supervision's; translation tasks take the target language."""
    own = F.coalesce(F.nullif(tags["lang"], F.lit("")), F.nullif(first, F.lit("")), F.lit(""))
    return F.when(task.isin("st", "translate"), F.coalesce(F.nullif(tags["tgt_lang"], F.lit("")), own)).otherwise(own)


def lowered_text(text: Column, task: Column) -> Column:
    """Stripped and lower-cased, but for quality estimation."""
    return F.when(task == "speechqe", text).otherwise(F.lower(stripped(text)))


def normalised_score(score: Column, factor: Column | None = None) -> Column:
    """A score over its normalising factor (1 if none)."""
    return score.cast("double") / F.coalesce(factor if factor is not None else F.lit(None).cast("double"), F.lit(1.0))


def portable_hash(seed: int, key: Column) -> Column:
    """An order that any engine can repeat."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def subsample(df: DataFrame, n: int, seed: int = 42, by: list[str] | None = None) -> DataFrame:
    """``n`` rows (per group) in hash order: a top-k, not a global sort."""
    if not by:
        return df.orderBy(portable_hash(seed, F.col("id")), "id").limit(n)
    place = Window.partitionBy(*by).orderBy(portable_hash(seed, F.col("id")), "id")
    return df.withColumn("place", F.row_number().over(place)).where(F.col("place") <= n).drop("place")


def stratified_split(df: DataFrame, by: str, ratio: float, seed: int = 42) -> DataFrame:
    """Adds ``split``: the first ``ratio`` of each stratum in hash order is 'train'.

    A stratum may hold any share of the rows, so places come from counts by hash prefix (65,536 cells a stratum): only
    the cell in which a stratum's bound falls is ordered.
    """
    h = df.withColumn("split_h", portable_hash(seed, F.col("id"))).withColumn("split_cell", F.substring("split_h", 1, 4))
    cells = h.groupBy(by, "split_cell").agg(F.count("*").alias("n"))
    run = Window.partitionBy(by).orderBy("split_cell")
    cells = cells.withColumn("before", F.sum("n").over(run) - F.col("n")).withColumn("want", F.round(F.sum("n").over(Window.partitionBy(by)) * ratio).cast("long"))
    edges = cells.where((F.col("before") < F.col("want")) & (F.col("before") + F.col("n") >= F.col("want")))
    edges = edges.select(F.col(by).alias("split_key"), F.col("split_cell").alias("edge_cell"), (F.col("want") - F.col("before")).alias("inside"))
    h = h.join(edges, F.col(by).eqNullSafe(F.col("split_key")), "left")
    at_edge = F.col("split_cell") == F.col("edge_cell")
    place = Window.partitionBy(by, F.when(at_edge, "edge").otherwise(F.substring("split_h", 5, 4))).orderBy("split_h", "id")
    train = F.when(at_edge, F.row_number().over(place) <= F.col("inside")).otherwise(F.coalesce(F.col("split_cell") < F.col("edge_cell"), F.lit(False)))
    return h.withColumn("split", F.when(train, "train").otherwise("validation")).drop("split_h", "split_cell", "split_key", "edge_cell", "inside")


def longest(df: DataFrame, n: int) -> DataFrame:
    """The ``n`` longest records, ties by id."""
    return df.orderBy(F.desc("duration"), "id").limit(n)


def shortest(df: DataFrame, n: int) -> DataFrame:
    return df.orderBy("duration", "id").limit(n)


def evaluation_order(df: DataFrame) -> DataFrame:
    """Longest first: seconds plus tokens, falling."""
    return df.orderBy(F.desc(F.col("duration") + F.coalesce("num_tokens", F.lit(0))), "id")


def named_sets(df: DataFrame) -> DataFrame:
    """Evaluation sets by name in order of first appearance; partly named input fails."""
    mixed = F.when((F.count("name") > 0) & (F.count("name") < F.count("*")), F.raise_error(F.lit("all or no sets need a name")))
    checked = df.agg(mixed.alias("bad"))
    return df.crossJoin(F.broadcast(checked)).where("bad IS NULL").groupBy("name").agg(F.min("pos").alias("first"), F.count("*").alias("sources")).orderBy("first")  # one row
