"""Labelled rows for the classifiers: which ones may be learnt from, and a bounded sample of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(folds: int, fold: int, doc_id: str = "doc_id") -> Column:
    """Whether crc32(doc_id as text) mod folds is fold; a null id is the empty text."""
    text = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % folds == fold


def training_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, most: int) -> DataFrame:
    """doc_id, label and text of at most so many labelled documents outside the held-out fold, the least by hash.

    The sample of labels is bounded by most rows of two numbers, which is why it may be broadcast. Rows with a null id or
    a label other than 0 and 1 teach nothing; an id that repeats in labels is taken once, with its greatest label.
    """
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("label"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(folds, fold)).groupBy("doc_id").agg(F.max("label").alias("label"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.join(F.broadcast(sample), "doc_id").select("doc_id", "label", "text")
