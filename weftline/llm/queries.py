"""The registered queries ``opN_<name>``: thin wrappers with production parameters over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import byte_bpe, nearest, packing, quality_classifier, quality_rules, secrets, simhash, token_counts, token_files, toxicity
from weftline.llm.common import table

END_ID = 1


def word_vocab_path() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE of every text and back; digests of the ids and of the decoded bytes."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    got = byte_bpe.round_trip(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return got.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed into sequences of 2048 tokens, by piece."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), word_vocab_path(), END_ID)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every text."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth."""
    return nearest.search(table(spark, sf_dir, "embeddings"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count of every text."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), word_vocab_path())


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every text and the verdict of rules and robust outliers."""
    return quality_rules.quality(table(spark, sf_dir, "documents"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every text."""
    return secrets.digest(secrets.find_secrets(table(spark, sf_dir, "documents")))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text written to token files in doc_id order, then read back."""
    files = token_files.write_token_files(table(spark, sf_dir, "documents"), word_vocab_path(), END_ID)
    return token_files.read_token_files(files)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every text."""
    docs = table(spark, sf_dir, "documents")
    return quality_classifier.score(docs, quality_classifier.fit(docs, table(spark, sf_dir, "labels")))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every text."""
    return simhash.digest(simhash.near_duplicates(table(spark, sf_dir, "documents")))


QUERIES = {
    f.__name__: f
    for f in (op1_byte_bpe, op2_packing, op3_toxicity, op4_nearest, op5_token_counts, op6_quality_rules, op7_secrets, op8_token_files, op9_quality_classifier, op10_simhash)
}
ORACLES: dict[str, str] = {}
