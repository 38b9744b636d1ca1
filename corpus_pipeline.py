"""Corpus preparation in five stages; each reads what the one before it has written as Parquet.

Quality classifier, quality rules, near-duplicates, secrets, packing. Every stage works on all rows its predecessor
kept; all but the last return the columns of ``documents``, further ones too.

Defined results: null and empty texts are scored, counted and linked as empty texts, so that the rules let none of them
pass, and would be packed as the end id alone; null ids pass through every stage and are judged by their texts; of repeated rows, and of
near copies, one stays, while different texts that share an id are judged apart; very long texts are worked on whole;
an empty table gives an empty table at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import packing, quality_classifier, quality_rules, secrets, simhash
from weftline.llm.common import drop_since, mark_written, table, written
from weftline.llm.queries import END_ID, word_vocab_path


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality_classifier.accepted(docs, quality_classifier.fit(docs, table(spark, sf_dir, "labels")))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and are no robust outliers."""
    return quality_rules.passing(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of smallest id, of each near-duplicate component."""
    return simhash.representatives(docs)


def scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets replaced; n_chars follows the text."""
    clean = secrets.redacted(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences."""
    return packing.pack_documents(docs, word_vocab_path(), END_ID)


STAGES = [("quality_classifier", classify), ("quality_rules", rules), ("near_duplicates", deduplicate), ("secret_scan", scan), ("packing", pack)]
#: Learned scores, fingerprints and tokenisation are not expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; tables that no later stage reads are deleted."""
    docs, mark = table(spark, sf_dir, "documents"), mark_written()
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
        drop_since(mark, docs)
    return docs
