"""Bounded samples of labelled rows, for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def crc_fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def class_counts(labels: DataFrame, label: str) -> dict[int, int]:
    """Labelled rows of each class."""
    return {int(r[0]): int(r[1]) for r in labels.where(F.col(label).isin(0, 1)).groupBy(F.col(label).cast("int")).count().collect()}


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, max_chars: int) -> DataFrame:
    """doc_id, text, y of at most per_class labelled documents of each class, one for each different text.

    Those with the smallest hash of the id are taken, so the same tables give the same sample. An id with both labels
    counts as 1, a text under several ids has its mean label. Texts of over max_chars are not used for fitting.
    """
    y = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label)).cast("double").alias("y"))
    ids = None
    for c in (0.0, 1.0):
        some = y.where(F.col("y") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        ids = some if ids is None else ids.unionByName(some)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).where(F.length("text") <= max_chars)
    return texts.join(F.broadcast(ids), "doc_id").groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.avg("y").alias("y"))
