"""R4 with keyed state: what an author likes already is stream state, so no micro-batch reads the store.

The edges that are stored when the stream first starts become its initial state, once, as a micro-batch of their own
that comes before every like. State is one entry an (author, paper) pair, kept by Spark's streaming
``dropDuplicates`` in RocksDB: a hot author is many small entries over all tasks, and no entry is a call from Python. A
like is passed on the first time its (author, paper) is seen, however late it is: without a watermark state never
expires. The file sink commits each batch once, so a replay after a failure adds nothing twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refrank.schemas import KIND_LIKED
from refrank.sources.store import exists
from refrank.streaming.likes import like_stream

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stored_likes(likes: DataFrame, stored: DataFrame) -> DataFrame:
    """(author_id, paper_id) of the liked edges of ``stored``, in the types of ``likes``."""
    liked = stored.where((F.col("kind") == KIND_LIKED) & F.col("paper_id").isNotNull())
    return liked.select(*[F.col(c).cast(likes.schema[c].dataType).alias(c) for c in ("author_id", "paper_id")])


def new_likes(likes: DataFrame, known: DataFrame) -> DataFrame:
    """Stream of (author_id, kind, paper_id): the ``likes`` (author_id, paper_id) that came neither before nor in an
    earlier micro-batch of the stream ``known`` (author_id, paper_id), which is not passed on itself."""
    pairs = ("author_id", "paper_id")
    both = known.select(*pairs, F.lit(False).alias("new")).unionByName(likes.select(*pairs, F.lit(True).alias("new")))
    fresh = both.dropDuplicates(list(pairs)).where("new")
    return fresh.select("author_id", F.lit(KIND_LIKED).alias("kind"), "paper_id")


def run_stateful_likes(
    spark: SparkSession, source: str, stored: DataFrame, sink: str, checkpoint: str, max_files: int | None = None
) -> None:
    """Process everything available now into the folder ``sink``, which holds what the stream added to ``stored``;
    a later run with the same ``checkpoint`` goes on from its state and does not read ``stored`` again."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS_DB)
    first = f"{checkpoint}/stored"
    likes = like_stream(spark, source, max_files)

    def run(likes: DataFrame) -> None:
        known = spark.readStream.schema(likes.schema).parquet(first)
        q = (
            new_likes(likes, known)
            .writeStream.format("parquet")
            .option("path", sink)
            .option("checkpointLocation", checkpoint)
            .outputMode("append")
            .trigger(availableNow=True)
            .start()
        )
        q.awaitTermination()

    try:
        if not exists(spark, f"{checkpoint}/commits/0"):
            # Written once: a batch that failed is replayed from the same files.
            if not exists(spark, f"{first}/_SUCCESS"):
                stored_likes(likes, stored).write.mode("overwrite").parquet(first)
            run(like_stream(spark, f"{checkpoint}/no-likes*"))  # a pattern that no file matches
        run(likes)
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)
