"""Map the driver's TPC-H-style test tables onto the recommender's tables.

Every builder reads the whole parquet tables lazily; Catalyst prunes columns and pushes filters
into the scans. Nothing is collected.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from refrank.schemas import KIND_LIKED, KIND_REFERENCE, KIND_WRITE


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _kind_of_flag(flag: Column) -> Column:
    return (
        F.when(flag == "N", F.lit(KIND_WRITE))
        .when(flag == "A", F.lit(KIND_REFERENCE))
        .when(flag == "R", F.lit(KIND_LIKED))
    )


class TestTables:
    """Recommender tables derived from one scale-factor folder."""

    __test__ = False  # not a pytest class

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def raw(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)

    @cached_property
    def papers(self) -> DataFrame:
        """part + lineitem counts: one row per paper, counts pre-aggregated before the join."""
        counts = (
            self.raw("lineitem")
            .groupBy(F.col("l_partkey").alias("paper_id"))
            .agg(
                F.count(F.lit(1)).alias("citation_count"),
                F.count(F.when(F.col("l_returnflag") == "R", 1)).alias("influential_citation_count"),
            )
        )
        key = F.col("p_partkey")
        part = self.raw("part").select(
            key.alias("paper_id"),
            F.col("p_name").alias("title"),
            F.when(key % 5 == 0, F.lit(None).cast("string")).otherwise(F.col("p_type")).alias("abstract"),
            F.when(key % 17 == 0, F.lit(None).cast("int"))
            .otherwise((F.lit(1990) + (key * 7) % 34).cast("int"))
            .alias("year"),
            F.col("p_size").cast("bigint").alias("reference_count"),
        )
        return part.join(counts, "paper_id", "left").select(
            "paper_id",
            "title",
            "abstract",
            "year",
            "reference_count",
            F.coalesce("citation_count", F.lit(0)).alias("citation_count"),
            F.coalesce("influential_citation_count", F.lit(0)).alias("influential_citation_count"),
        )

    @cached_property
    def paper_embeddings(self) -> DataFrame:
        return self.raw("embeddings").select(
            F.col("vec_id").alias("paper_id"),
            F.col("embedding").cast("array<double>").alias("embedding"),
        )

    @cached_property
    def authors(self) -> DataFrame:
        return self.raw("customer").select(
            F.col("c_custkey").alias("author_id"), F.col("c_name").alias("name")
        )

    @cached_property
    def interactions(self) -> DataFrame:
        """Distinct (author, kind, paper) edges: orders joined to their line items."""
        orders = self.raw("orders").select("o_orderkey", "o_custkey")
        items = self.raw("lineitem").select("l_orderkey", "l_partkey", "l_returnflag")
        return (
            orders.join(items, orders.o_orderkey == items.l_orderkey)
            .select(
                F.col("o_custkey").alias("author_id"),
                _kind_of_flag(F.col("l_returnflag")).alias("kind"),
                F.col("l_partkey").alias("paper_id"),
            )
            .distinct()
        )

    @cached_property
    def raw_papers(self) -> DataFrame:
        """Landed paper rows with duplicate keys: (file, pos) gives the first-seen order."""
        return self.raw("orders").select(
            F.col("o_custkey").alias("paper_id"),
            F.lit("orders.parquet").alias("file"),
            F.col("o_orderkey").alias("pos"),
            F.col("o_orderpriority").alias("title"),
        )

    @cached_property
    def nested_papers(self) -> DataFrame:
        """Papers with nested ``authors`` and ``references`` arrays, as the JSON source holds them."""
        n = self.raw("part").agg(F.count(F.lit(1))).scalar()
        pid = F.col("paper_id")
        writers = (
            self.interactions.where(F.col("kind") == KIND_WRITE)
            .select(
                "paper_id",
                F.struct(
                    F.col("author_id").alias("sort_key"),
                    F.when(F.col("author_id") % 13 == 0, F.lit(None).cast("bigint"))
                    .otherwise(F.col("author_id"))
                    .alias("authorId"),
                    F.concat(
                        F.lit("A"), F.col("author_id").cast("string"), F.lit("#"),
                        (pid % 3).cast("string"),
                    ).alias("name"),
                ).alias("a"),
            )
            .groupBy("paper_id")
            .agg(F.array_sort(F.collect_list("a")).alias("a"))
            .select(
                "paper_id",
                F.transform("a", lambda s: F.struct(s["authorId"].alias("authorId"), s["name"].alias("name"))).alias(
                    "authors"
                ),
            )
        )
        refs = F.array(
            F.struct(((pid * 3 + 1) % n).alias("paperId")),
            F.struct(
                F.when(pid % 11 == 0, F.lit(None).cast("bigint")).otherwise((pid * 5 + 2) % n).alias("paperId")
            ),
        )
        return (
            self.papers.join(writers, "paper_id", "left")
            .withColumn("authors", F.coalesce("authors", F.array().cast(writers.schema["authors"].dataType)))
            .withColumn("references", refs)
        )

    @cached_property
    def like_events(self) -> DataFrame:
        """Purchase events read as likes: (author_id, paper_id, event_time)."""
        return (
            self.raw("events")
            .where(F.col("event_type") == "purchase")
            .select(
                F.col("user_id").alias("author_id"),
                F.get_json_object("props", "$.k").cast("bigint").alias("paper_id"),
                F.col("ts").cast("timestamp").alias("event_time"),
            )
        )

    @cached_property
    def documents(self) -> DataFrame:
        return self.raw("documents").select("doc_id", "text")
