"""Bounded samples of labelled rows for the learned operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import remainder, written

#: Most labelled rows that a fit reads; chosen by a hash of the id, so alike at every size.
FIT_ROWS = 20_000


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, modulus: int, held_out: int, limit: int = FIT_ROWS) -> DataFrame:
    """At most ``limit`` labelled rows (doc_id, text, label) outside the held-out fold, written to the shared folder.

    Rows with a null id or label are left out, an id with several labels takes the greatest. An id that ``documents``
    repeats gives one row, that of its least text, so that the bound holds for rows. The label side is bounded by
    ``limit`` and therefore broadcast whatever the size of the corpus.
    """
    key = labels["doc_id"].cast("long")
    known = labels.select(key.alias("doc_id"), labels[target].cast("int").alias("label"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & (remainder(F.col("doc_id"), modulus) != held_out))
    known = known.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    return written(texts.join(F.broadcast(known), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")), "sample")
