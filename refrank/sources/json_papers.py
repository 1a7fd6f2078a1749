"""Paper sources: landed JSON search pages (S1, S3), bulk JSON-lines releases (S2), nested vector
responses (S4). Always an explicit schema, resolved by field name. Malformed input fails the read: it
never becomes missing or all-NULL papers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from refrank.schemas import PAPER_JSON
from refrank.session import cut_lineage

FAIL = {"mode": "FAILFAST"}
# Fixed value: landed page names are "<query>-<from>-<to>.json".
PAGE_NAME = r"^(.*)-(\d+)-(\d+)\.json$"


def read_paper_pages(spark: SparkSession, path: str, schema: T.StructType = PAPER_JSON) -> DataFrame:
    """A folder of files, each one JSON array of paper records.

    Each file is read whole (an array is not splittable), parsed with the fixed schema and exploded
    with its position, giving a deterministic first-seen order (file name, pos). The page query and
    offsets are parsed from the file name."""
    raw = spark.read.text(path, wholetext=True).select(
        F.url_decode(F.col("_metadata.file_path")).alias("file"),
        F.url_decode(F.col("_metadata.file_name")).alias("_name"),
        F.from_json("value", T.ArrayType(schema), FAIL).alias("recs"),
    )
    return raw.select(
        "file",
        F.regexp_extract("_name", PAGE_NAME, 1).alias("query"),
        F.regexp_extract("_name", PAGE_NAME, 2).alias("offset_from"),
        F.regexp_extract("_name", PAGE_NAME, 3).alias("offset_to"),
        F.posexplode("recs").alias("pos", "rec"),
    ).select("file", "query", "offset_from", "offset_to", "pos", "rec.*")


def read_release(spark: SparkSession, path: str, schema: T.StructType = PAPER_JSON, partitions: int | None = None) -> DataFrame:
    """Bulk release, JSON lines (optionally gzip). A gzip file is one split, so the rows are
    spread with a round-robin repartition before any wide work."""
    df = spark.read.schema(schema).options(**FAIL).json(path)
    return df.repartition(partitions) if partitions else df


VECTOR_RESPONSE = T.StructType(
    [
        T.StructField("paperId", T.StringType()),
        T.StructField(
            "embedding",
            T.StructType([T.StructField("model", T.StringType()), T.StructField("vector", T.ArrayType(T.DoubleType()))]),
        ),
    ]
)


def read_vector_responses(spark: SparkSession, path: str) -> DataFrame:
    """(paper_id, embedding) from landed per-paper responses holding ``embedding.vector``."""
    df = spark.read.schema(VECTOR_RESPONSE).options(**FAIL).json(path)
    return df.select(F.col("paperId").alias("paper_id"), F.col("embedding").getField("vector").alias("embedding"))


def to_store_columns(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Landed camelCase fields -> stored snake_case columns (by name, never by position)."""
    return df.select(
        *keep,
        F.col("paperId").alias("paper_id"),
        "title",
        "abstract",
        "year",
        F.col("referenceCount").alias("reference_count"),
        F.col("citationCount").alias("citation_count"),
        F.col("influentialCitationCount").alias("influential_citation_count"),
        "authors",
        "references",
    )


def write_paper_pages(
    df: DataFrame, path: str, page_size: int = 100, page_key: str | None = None, sort_key: str | None = None
) -> None:
    """Land papers as JSON-array pages of about ``page_size`` records (builds ingest fixtures).

    With ``page_key`` (numeric) pages are ranges of it, like an ordered crawl: page folders are
    zero-padded so file paths sort in page order, and records inside a page follow ``sort_key``.
    Without it pages are hash buckets of the id sized from the row count. Either way every
    collected page is bounded by the page size; ``partitionBy`` puts each page in its own file."""
    sort_key = sort_key or "paperId"
    if page_key is not None:
        page = F.lpad(F.floor(F.col(page_key) / F.lit(page_size)).cast("string"), 12, "0")
    else:
        df = cut_lineage(df)  # counted, then landed
        pages = max(1, -(-df.count() // page_size))
        page = F.pmod(F.xxhash64("paperId"), F.lit(pages)).cast("string")
    cols = [c for c in df.columns if c not in {page_key, sort_key} or c == "paperId"]
    (
        df.withColumn("_page", page)
        .groupBy("_page")
        .agg(F.sort_array(F.collect_list(F.struct(F.col(sort_key).alias("_k"), F.struct(*cols).alias("r")))).alias("_rs"))
        .select("_page", F.to_json(F.col("_rs").getField("r")).alias("value"))
        .write.mode("overwrite")
        .partitionBy("_page")
        .text(path)
    )
