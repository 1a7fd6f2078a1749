"""Faults on odd input: late likes, malformed files, NULL keys, string ids, unknown authors."""

import pytest
from pyspark.sql import functions as F

from refrank.operators import mutations as M
from refrank.operators import papers as P
from refrank.plans import batch as B
from refrank.plans.profile_pages import author_page
from refrank.sources.json_papers import read_paper_pages, read_release
from refrank.sources.store import VersionedTable, create_table, scratch_path
from refrank.streaming.likes import run_like_stream

EDGES = "author_id long, kind string, paper_id long"


def test_a_like_ten_hours_late_is_stored(spark):
    landing, store = scratch_path(spark, "late"), scratch_path(spark, "late-store")
    for user, hour in ((1, 20), (2, 21), (3, 10)):
        spark.sql(
            f"""SELECT 1L AS event_id, TIMESTAMP_NTZ '2024-01-01 {hour}:00:00' AS ts, {user}L AS user_id,
            'purchase' AS event_type, 1.0D AS value, '{{"k": 7}}' AS props"""
        ).coalesce(1).write.mode("append").parquet(landing)
    create_table(spark, store, spark.createDataFrame([], EDGES).schema)
    run_like_stream(spark, landing, store, scratch_path(spark, "late-ckpt"), max_files=1)
    assert {r.author_id for r in spark.read.parquet(store).collect()} == {1, 2, 3}


def test_truncated_page_and_line_fail(spark, tmp_path):
    (tmp_path / "q-0-1.json").write_text('[{"paperId": "1", "title": "a"}]')
    (tmp_path / "q-1-2.json").write_text('[{"paperId": "2", "title": "b"')
    with pytest.raises(Exception, match="(?i)malformed"):
        read_paper_pages(spark, str(tmp_path)).collect()
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines" / "a.json").write_text('{"paperId": "1"}\n{"paperId": "2", "tit')
    with pytest.raises(Exception, match="(?i)malformed"):
        read_release(spark, str(tmp_path / "lines")).collect()


def test_null_key_is_refused(spark):
    stored = spark.createDataFrame([(1, "a")], "k long, t string")
    batch = spark.createDataFrame([(None, "b"), (2, "c")], "k long, t string")
    with pytest.raises(Exception, match="NULL k"):
        P.insert_or_ignore(stored, batch, "k", ["t"]).collect()


def test_allocate_ids_serves_a_full_space(spark):
    authors = spark.range(9_998).select(F.col("id").alias("author_id"))
    got = [r.author_id for r in M.allocate_ids(authors, 100).collect()]
    assert len(set(got)) == 100 and min(got) >= 9_998


def test_clear_liked_keeps_rows_with_nulls(spark):
    rows = [(1, "liked", 1), (1, None, 2), (None, "liked", 3), (2, "liked", 4)]
    left = M.clear_liked(spark.createDataFrame(rows, EDGES), 1).collect()
    assert {r.paper_id for r in left} == {2, 3, 4}


def test_like_for_an_unknown_author_raises(spark):
    authors = spark.createDataFrame([(1, "a")], "author_id long, name string")
    edges, ids = spark.createDataFrame([], EDGES), spark.createDataFrame([(5,)], "paper_id long")
    with pytest.raises(ValueError):
        M.like_papers(authors, edges, 9, ids)


def test_author_without_papers_has_a_page(spark):
    authors = spark.createDataFrame([(1, "a")], "author_id long, name string")
    papers = spark.createDataFrame([], "paper_id long, title string, year int, citation_count long")
    rows = author_page(authors, spark.createDataFrame([], EDGES), papers, 1).collect()
    assert [(r.name, r.paper_id) for r in rows] == [("a", None)]


def test_commit_after_a_failed_write(spark):
    table = VersionedTable(spark, scratch_path(spark, "versions"), spark.createDataFrame([], "x long").schema)
    table.commit(spark.range(3).withColumnRenamed("id", "x"))
    broken = spark.range(3).select(F.raise_error(F.lit("stop")).cast("long").alias("x"))
    for _ in range(2):
        with pytest.raises(Exception, match="stop"):
            table.commit(broken)
    assert table.current().count() == 3
    assert table.commit(spark.range(5).withColumnRenamed("id", "x")).count() == 5
    assert table.current().count() == 5


@pytest.mark.parametrize("block", [None, 7])
def test_string_ids_with_empty_blocks(spark, block):
    n = 30
    papers = spark.range(n).select(
        F.format_string("p%03d", "id").alias("paper_id"), F.lit("t").alias("title"), (F.col("id") % 5).alias("reference_count"),
        (F.col("id") % 7).alias("citation_count"), F.lit(1).cast("long").alias("influential_citation_count"), F.lit(2000).alias("year"),
    )
    vectors = spark.range(n).select(
        F.format_string("p%03d", "id").alias("paper_id"), F.array(*[F.sin(F.col("id") * (k + 1)) for k in range(4)]).alias("embedding")
    )
    edges = spark.range(4).select(F.format_string("a%d", "id").alias("author_id"), F.lit("write").alias("kind"), F.format_string("p%03d", "id").alias("paper_id"))
    extra = {"paper_block": block} if block else {}
    assert B.batch_recommend_cosine(papers, vectors, edges, 5, **extra).count() == 20
    one = {(r.author_id, r.paper_id) for r in B.batch_recommend_weighted(papers, vectors, edges, k=5).collect()}
    many = B.batch_recommend_weighted(papers, vectors, edges, k=5, paper_block=block or 4096)
    assert {(r.author_id, r.paper_id) for r in many.collect()} == one and len(one) == 20
