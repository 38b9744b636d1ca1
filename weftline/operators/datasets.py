"""Typed datasets, source specifications, and what a record says about itself."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.text import stripped
from weftline.sources import manifests


@dataclass
class Dataset:
    """A corpus laid out as ``root/config/lang/split`` with its allowed values."""

    root: str
    configs: list[str] = field(default_factory=list)
    languages: list[str] = field(default_factory=list)
    splits: list[str] = field(default_factory=lambda: ["train", "validation", "test"])

    def path(self, split: str, lang: str | None = None, config: str | None = None) -> str:
        for name, value, allowed in (("split", split, self.splits), ("lang", lang, self.languages), ("config", config, self.configs)):
            if allowed and value not in allowed:
                raise ValueError(f"{name} {value!r} is not one of {allowed}")
        return "/".join(p for p in (self.root, config, lang, split) if p)

    def load(self, spark: SparkSession, split: str, lang: str | None = None, config: str | None = None) -> DataFrame:
        return manifests.read_manifests(spark, [self.path(split, lang, config)])

    def available(self, spark: SparkSession) -> list[str]:
        return [p for p in (e["path"] for e in manifests.dataset_tree(spark, self.root)) if manifests.manifest_files(spark, p)]


def resolve(spark: SparkSession, spec: str, split: str, limit: int | None = None) -> DataFrame:
    """``shar::path`` names a manifest folder, ``cuts::path`` a single file, any other a Parquet snapshot with that split."""
    kind, _, path = spec.rpartition("::")
    if kind == "shar":
        df, order = manifests.read_manifests(spark, [path]), ["shard", "id"]
    elif kind == "cuts":
        df, order = manifests.read_cuts_file(spark, path), ["id"]
    else:
        df, order = spark.read.parquet(f"{spec}/{split}"), []
    return df if limit is None else df.orderBy(*order).limit(limit) if order else df.limit(limit)


def sharded(df: DataFrame, shards: int, index: int, key: str = "id") -> DataFrame:
    """One worker's share of a source: disjoint and complete over the indexes."""
    if not 0 <= index < shards:
        raise ValueError(f"no shard {index} of {shards}")
    return df.where(F.pmod(F.col(key), F.lit(shards)) == index)


def source_key(kind: str, path: str) -> str:
    return f"{'shar' if kind == 'lhotse_shar' else 'cuts'}::{path}"


def path_columns(path: Column) -> dict[str, Column]:
    """Name and dataset of a source: the last and third-last part of its path."""
    parts = F.split(F.rtrim(path, F.lit("/")), "/")
    return {"name": F.element_at(parts, -1), "dataset": F.when(F.size(parts) >= 3, F.element_at(parts, -3))}


def record_language(supervisions: Column, own: Column) -> Column:
    """The first supervision's language, else the record's, else 'unknown'."""
    return F.coalesce(F.nullif(F.get(supervisions, 0)["language"], F.lit("")), F.nullif(own, F.lit("")), F.lit("unknown"))


def punctuated(custom: Column) -> Column:
    return F.coalesce(F.get_json_object(custom, "$.pnc_text") != "", F.lit(False))


def joined_text(supervisions: Column) -> Column:
    """All supervision texts, first to last, by blanks; null if nothing is left."""
    return F.nullif(F.array_join(F.filter(F.transform(supervisions, lambda s: stripped(s["text"])), lambda t: t != ""), " "), F.lit(""))


def scored_rows(df: DataFrame, score: str, factor: Column) -> DataFrame:
    """Records with a usable text and score, as text and score in [0, 1] units."""
    value = F.get_json_object("custom", "$." + score).try_cast("double") / factor
    return df.select("id", joined_text(F.col("supervisions")).alias("text"), value.alias("score")).where("text is not null and score is not null")


def manifest_ids(spark: SparkSession, source: str) -> DataFrame:
    return manifests.read_manifests(spark, [source]).select("id").distinct()


def latest_checkpoint(paths: DataFrame) -> DataFrame:
    """Of paths ``.../checkpoint-N`` the one of greatest N."""
    n = F.regexp_extract("path", r"checkpoint-(\d+)/?$", 1).try_cast("long")
    return paths.withColumn("n", n).where("n is not null").agg(F.max_by("path", "n").alias("path"), F.max("n").alias("step"))
