"""Conversion of tabular corpora into records: one declarative recipe per corpus, one Spark job per run."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Recipe:
    """Which columns hold id, text, duration and language, and what goes to ``custom``."""

    name: str
    text: str
    id: str | None = "id"
    duration: str | None = "duration"
    language: str | None = None
    custom: dict[str, str] = field(default_factory=dict)
    shard_size: int = 1000


# Text columns and custom fields of the supported corpora.
RECIPES = {
    r.name: r
    for r in (
        Recipe("yodas", "text", language="lang", custom={"translation_en": "translation_en", "original_audio_id": "original_audio_id", "original_audio_offset": "original_audio_offset"}),
        Recipe("fleurs", "transcription", language="locale"),
        Recipe("voxpopuli", "raw_text", id="audio_id", language="language"),
        Recipe("librispeech", "text"),
        Recipe("peoples_speech", "text"),
        Recipe("common_voice", "sentence", id="path", language="locale", shard_size=25_000),
        Recipe("mls", "transcript", language="language", shard_size=4_000),
    )
}


def clean_id(value: Column, fallback: Column) -> Column:
    """Slashes and dots as _; a missing id takes the fallback."""
    return F.coalesce(F.nullif(F.regexp_replace(value.cast("string"), r"[/.]", "_"), F.lit("")), fallback)


def to_records(df: DataFrame, recipe: Recipe) -> DataFrame:
    """Records with one supervision over the whole recording; rows without usable text carry ``error``."""
    have = set(df.columns)
    at = lambda name, kind: F.col(name).cast(kind) if name in have else F.lit(None).cast(kind)
    number = F.monotonically_increasing_id()
    fallback = F.format_string("chunk%d_item%d", F.shiftright(number, 33), F.pmod(number, F.lit(1 << 33)))
    ident, text, length = clean_id(at(recipe.id or "", "string"), fallback), at(recipe.text, "string"), at(recipe.duration or "", "double")
    language = F.substring_index(at(recipe.language or "", "string"), "_", 1)
    present = {k: v for k, v in recipe.custom.items() if v in have}
    custom = F.to_json(F.struct(*[F.col(v).alias(k) for k, v in present.items()])) if present else F.lit(None).cast("string")
    one = df.select(ident.alias("id"), length.alias("duration"), text.alias("text"), language.alias("language"), F.when(custom != "{}", custom).alias("custom"))
    supervision = F.struct(F.col("id"), F.col("id").alias("recording_id"), F.lit(0.0).alias("start"), F.col("duration"), F.col("text"), F.col("language"))
    return one.select("id", "duration", F.array(supervision).alias("supervisions"), "custom", F.when(F.col("text").isNull(), "no text").alias("error"))


def counters(records: DataFrame) -> DataFrame:
    """Records and errors of a conversion."""
    return records.agg(F.count_if(F.col("error").isNull()).alias("records"), F.count_if(F.col("error").isNotNull()).alias("errors"))


def concatenated(parts: list[DataFrame]) -> DataFrame:
    """Splits written as ``a+b``: every record once."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def workers_for(n: int, wanted: int, shard_size: int) -> int:
    return min(wanted, max(1, n // shard_size))


def worker_of(position: Column, shards: int, workers: int) -> Column:
    """Contiguous shards to workers, by ceiling division."""
    return F.floor(position / -(-shards // workers)).cast("int")


def webdataset_records(members: DataFrame) -> DataFrame:
    """Audio members joined with their metadata by stem; text from ``transcript``, the metadata kept in ``custom``."""
    audio = members.where(F.col("extension").isin("wav", "flac", "mp3", "ogg")).select("tar", "stem", "name", F.length("content").alias("bytes"))
    meta = members.where(F.col("extension").endswith("json")).select("tar", "stem", F.decode("content", "UTF-8").alias("metadata"))
    return audio.join(meta, ["tar", "stem"]).select(F.regexp_replace("stem", r"[/.]", "_").alias("id"), F.get_json_object("metadata", "$.transcript").alias("text"), F.col("metadata").alias("custom"), "name", "bytes")
