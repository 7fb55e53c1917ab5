"""Rows that may be learned from, with their labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_LABELS = 2_000_000


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the doc_id as text, modulo `folds`; null for a null doc_id."""
    return F.crc32(doc_id.cast("string")) % folds


def held_out(folds: int, remainder: int, doc_id: str = "doc_id") -> Column:
    """Whether a row is set apart; rows without a doc_id are not."""
    return F.coalesce(fold(F.col(doc_id), folds) == remainder, F.lit(False))


def labelled_rows(
    docs: DataFrame, labels: DataFrame, column: str, folds: int = 5, remainder: int = 0, how: str = "inner"
) -> DataFrame:
    """doc_id, text, label and a hash (`draw`) of the labelled documents that are not set apart.

    With how="left" the other documents follow with a null label.
    Of several labels of a doc_id the highest counts; null labels and labels without a document are left
    out. Labels filter the scan as a broadcast up to BROADCAST_LABELS of them, and otherwise through a
    join; the result is the same.
    """
    known = (
        labels.filter(F.col("doc_id").isNotNull() & F.col(column).isNotNull())
        .filter(fold(F.col("doc_id"), folds) != remainder)
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max(F.col(column).cast("int")).alias("label"))
    )
    if labels.count() <= BROADCAST_LABELS:
        known = F.broadcast(known)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.join(known, "doc_id", how).withColumn("draw", F.xxhash64("doc_id"))
