"""Labels and held-out folds for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def fold(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id has no fold."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n


def held_out(doc_id: str, n: int, kept_back: int) -> Column:
    return F.coalesce(fold(doc_id, n) == kept_back, F.lit(False))


def training_labels(labels: DataFrame, column: str, n: int, held: int) -> DataFrame:
    """(doc_id, label) of the rows that may be learned from: one per id, the larger if they disagree; nulls go."""
    return (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out("doc_id", n, held))
        .groupBy("doc_id").agg(F.max("label").alias("label"))
    )


def share(doc_id: str, part: float) -> Column:
    """A fixed share of ids by hash."""
    return F.pmod(F.xxhash64(doc_id, F.lit(17)), F.lit(1 << 30)) < int(part * (1 << 30))
