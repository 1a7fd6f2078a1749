"""Initialise every table from landed paper pages.

pages (S1) → first-wins papers (A1) → stored papers (S11, S5) → profiles (A2) → content (F4) →
long-text embeddings (F5, F7, A5 = R8) → stored embeddings with content hashes (S7, S13).
Every step is a DataFrame job; nothing is capped (the original embedded only the first 10,000)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from refrank.operators.papers import first_seen
from refrank.operators.profiles import profiles_from_papers
from refrank.sources.json_papers import read_paper_pages, to_store_columns
from refrank.streaming.incremental import embed_new_content


def initialize(spark: SparkSession, landing: str, root: str, dim: int = 64) -> dict[str, DataFrame]:
    root = root.rstrip("/")
    landed = read_paper_pages(spark, landing)
    # First-wins rows keep their scan position (file, pos) until the profiles are derived, so the
    # first spelling of an author follows the landed order, not the id's string order.
    firsts = _first_wins(landed)
    firsts.write.mode("overwrite").parquet(f"{root}/_papers_scan")
    firsts = spark.read.parquet(f"{root}/_papers_scan")
    firsts.drop("file", "pos").write.mode("overwrite").parquet(f"{root}/papers")
    papers = spark.read.parquet(f"{root}/papers")
    names, edges = profiles_from_papers(firsts, order=("file", "pos"))
    names.write.mode("overwrite").parquet(f"{root}/authors")
    edges.write.mode("overwrite").parquet(f"{root}/interactions")
    empty = spark.createDataFrame([], "paper_id string, content_sha string, embedding array<double>")
    embed_new_content(papers, empty, dim).write.mode("overwrite").parquet(f"{root}/paper_embeddings")
    return {
        name: spark.read.parquet(f"{root}/{name}")
        for name in ("papers", "authors", "interactions", "paper_embeddings")
    }


def _first_wins(landed: DataFrame) -> DataFrame:
    """A1 over landed pages: first (file, pos) wins per paper id; stored columns by name, plus the
    winning (file, pos)."""
    stored = to_store_columns(landed, keep=("file", "pos"))
    return first_seen(stored, "paper_id", ["file", "pos"])
