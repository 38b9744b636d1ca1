"""Word and character error rates with language and task splits; vector comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import basic_normalised, long_char_edits, stripped, word_edits, words


def edits(df: DataFrame, reference: str = "reference", prediction: str = "prediction", normalise: bool = True) -> DataFrame:
    """Adds word and character edits and the reference's lengths."""
    ref, hyp = (basic_normalised(F.col(c), nfkc=True) if normalise else F.col(c) for c in (reference, prediction))
    df = df.withColumn("e_ref", ref).withColumn("e_hyp", hyp).withColumn("e_rw", words(F.col("e_ref"))).withColumn("e_hw", words(F.col("e_hyp")))
    return df.select(
        "*",
        F.when(F.size("e_rw") == 0, F.size("e_hw")).otherwise(word_edits(F.col("e_rw"), F.col("e_hw"))).cast("long").alias("word_edits"),
        F.size("e_rw").cast("long").alias("ref_words"),
        long_char_edits(F.col("e_ref"), F.col("e_hyp")).alias("char_edits"),
        F.length("e_ref").cast("long").alias("ref_chars"),
    ).drop("e_ref", "e_hyp", "e_rw", "e_hw")


def rate(part: Column, whole: Column) -> Column:
    """Null where the reference is empty."""
    return F.when(F.sum(whole) > 0, F.round(F.sum(part) / F.sum(whole), 9))


def error_rates(scored: DataFrame, by: list[str]) -> DataFrame:
    """Corpus-level rates by bucket; blank codes count as 'unknown'."""
    keys = [F.coalesce(F.nullif(stripped(F.col(c)), F.lit("")), F.lit("unknown")).alias(c) for c in by]
    return scored.groupBy(*keys).agg(
        F.count("*").alias("samples"), rate(F.col("word_edits"), F.col("ref_words")).alias("wer"), rate(F.col("char_edits"), F.col("ref_chars")).alias("cer")
    )


def split_rates(scored: DataFrame, code: str) -> DataFrame:
    """Rates by language or task, only where there is more than one bucket; an unknown task is counted but not shown."""
    rates = error_rates(scored, [code])
    several = rates.agg((F.count("*") > 1).alias("several"))
    out = rates.crossJoin(F.broadcast(several)).where("several").drop("several")  # one row
    return out.where(F.col(code) != "unknown") if code == "task" else out


def vector_difference(a: Column, b: Column) -> dict[str, Column]:
    """Greatest and mean absolute difference and cosine of two arrays."""
    gap = F.zip_with(a, b, lambda x, y: F.abs(x - y))
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    return {
        "max_abs": F.array_max(gap).cast("double"),
        "mean_abs": F.aggregate(gap, F.lit(0.0), lambda s, x: s + x) / F.size(gap),
        "cosine": dot(a, b) / F.sqrt(dot(a, a) * dot(b, b)),
    }


def top_overlap(a: Column, b: Column, k: int = 10) -> Column:
    """How many of the k greatest places two arrays share."""
    best = lambda c: F.transform(F.slice(F.sort_array(F.transform(c, lambda x, i: F.struct((-x).alias("v"), i.alias("i")))), 1, k), lambda s: s["i"])
    return F.size(F.array_intersect(best(a), best(b)))
