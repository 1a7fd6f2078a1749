"""Helpers shared by the corpus operators.

Conventions of every operator here:

* the input needs ``doc_id`` (bigint) and ``text`` (string); all other columns are ignored unless the
  operator says otherwise, so columns that share a name with an output cannot clash;
* a NULL text is read as the empty text; a NULL doc_id is an ordinary row that sorts after every id;
* a row that is repeated in the input is repeated in a per-document result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from refrank.session import checkpoint_dir

LONG_MAX = (1 << 63) - 1


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def id_text(docs: DataFrame) -> DataFrame:
    """(doc_id bigint, text string), NULL texts as empty."""
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )


def row_key(doc_id: Column, text: Column) -> Column:
    """128-bit digest of (doc_id, text): equal rows share it, a repeated id with another text does not."""
    return F.md5(
        F.concat(
            F.coalesce(doc_id.cast("string"), F.lit("null")),
            F.lit(":"),
            F.coalesce(text.cast("string"), F.lit("")),
        )
    )


def per_text(docs: DataFrame, fn: Callable[[list[str]], list[pa.Array]], fields: str) -> DataFrame:
    """(doc_id, *fields): ``fn`` maps the texts of one Arrow batch to one array per field."""
    names = [f.split()[0] for f in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cols = fn(b.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["doc_id", *names])

    return id_text(docs).mapInArrow(run, f"doc_id long, {fields}")


def materialise(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared checkpoint folder: survives the loss of any executor."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
