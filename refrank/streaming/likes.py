"""A stream of like events becomes ``liked`` edges in the profile store.

readStream (file source) → ``foreachBatch`` idempotent merge: only edges not yet stored are appended,
so a replayed micro-batch or a repeated like changes nothing. The store itself is the state: no
watermark drops a like that arrives late, however old its event is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refrank.operators.mutations import EDGE_COLUMNS, new_edges
from refrank.schemas import KIND_LIKED
from refrank.sources.store import append

EVENTS_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def like_stream(spark: SparkSession, source: str, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(EVENTS_SCHEMA)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return (
        reader.parquet(source)
        .where(F.col("event_type") == "purchase")
        .select(
            F.col("user_id").alias("author_id"),
            F.get_json_object("props", "$.k").cast("long").alias("paper_id"),
        )
        .where(F.col("paper_id").isNotNull())
    )


def merge_likes_into(store_path: str, table: str | None = None):
    """foreachBatch sink: append the batch's new (author, liked, paper) edges to the store.

    ``table`` names a store bucketed by ``author_id`` (``sources.store.write_bucketed``): it is read
    through the catalog, so the anti-join shuffles only the micro-batch, and appended in place."""

    def merge(batch: DataFrame, epoch_id: int) -> None:
        spark = batch.sparkSession
        # The merge reads the batch twice (edges, and its authors to trim the store): compute the
        # micro-batch once. A failed batch is replayed from the source offsets, so this is safe.
        batch = batch.persist()
        try:
            stored = spark.table(table) if table else spark.read.parquet(store_path)
            edges = batch.select("author_id", F.lit(KIND_LIKED).alias("kind"), "paper_id")
            fresh = new_edges(stored, edges).select(*EDGE_COLUMNS)
            if table:
                fresh.write.insertInto(table)
            else:
                append(fresh, store_path)
        finally:
            batch.unpersist()

    return merge


def run_like_stream(
    spark: SparkSession, source: str, store_path: str, checkpoint: str, table: str | None = None, **kw
) -> None:
    """Process everything available now (exactly-once through the stream checkpoint), then stop."""
    q = (
        like_stream(spark, source, **kw)
        .writeStream.foreachBatch(merge_likes_into(store_path, table))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    if table:
        # The stream writes through its own session; drop this session's cached file listing.
        spark.catalog.refreshTable(table)
