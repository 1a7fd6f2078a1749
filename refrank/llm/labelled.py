"""Labelled rows for the classifiers: which rows may teach, and how many of them are used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_LABELLED = 20_000  # labelled rows that a classifier is fitted on, at most about so many


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Rows whose labels are never learned from; a NULL id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus == remainder, F.lit(True))


def teachers(labels: DataFrame, label: str, modulus: int, remainder: int, most: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, label double): rows that may teach, one per id (the larger label on a tie).

    A sample by hash of the id when there are more than ``most``, so what is learned from is bounded and
    the same on every run. The ids are few enough to broadcast."""
    rows = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
        .groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
        .agg(F.max(F.col(label).cast("double")).alias("label"))
        .where(~held_out(F.col("doc_id"), modulus, remainder))
    )
    n = rows.count()
    if n <= most:
        return rows
    return rows.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit("teach")), F.lit(1_000_000)) < int(1_000_000 * most / n))


def labelled(rows: DataFrame, taught: DataFrame) -> DataFrame:
    """``rows`` that have a label. ``taught`` is bounded by its sampling, so it may be broadcast."""
    return rows.join(F.broadcast(taught), "doc_id")
