"""The bounded sample of labelled documents from which the classifiers learn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def crc(doc_id: str | Column = "doc_id") -> Column:
    """crc32 of the doc_id as text."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string"))


def sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, rows: int) -> DataFrame:
    """text and label of at most `rows` labelled documents for which `learn` holds, the first by a hash of doc_id.

    A document with several labels has the largest; null labels count as none. The labels kept are bounded by `rows`
    (16 bytes each), so they are broadcast and the documents are only scanned.
    """
    own = labels.where(learn & F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(own), "doc_id").select("doc_id", "text", "label")
