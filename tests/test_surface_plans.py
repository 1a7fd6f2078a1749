"""Plans and edge rows of the composite surface: search, browse pages, whole rows, exact integer ranks."""

import re

from pyspark.sql import functions as F

from refrank.operators.papers import page_after
from refrank.operators.profiles import missing_embeddings
from refrank.operators.ranking import global_row_numbers
from refrank.plans.profile_pages import author_page
from refrank.plans.recommend import order_by_field, rank_by_similarity
from refrank.plans.search import keyword_buckets, search_index, text_index
from refrank.sources.store import persist


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_search_scans_a_stored_index_without_a_shuffle(spark):
    corpus = spark.createDataFrame([(1, "alpha beta beta"), (2, "gamma"), (3, ""), (4, None)], "id long, t string")
    index = persist(text_index(corpus, "id", "t"), "index")
    found = search_index(index, "id", "Beta", k=5)
    assert "Exchange" not in plan(found).replace("BroadcastExchange", "Exchange")
    rows = found.collect()
    assert [r.id for r in rows] == [1, 2] and round(rows[0].similarity, 6) == round(2 / 5**0.5, 6)
    assert rows[1].similarity == 0.0
    assert [r.similarity for r in search_index(index, "id", "?!").collect()] == [0.0, 0.0]


def test_no_exchange_of_the_index_build_carries_text(spark):
    corpus = spark.sparkContext.parallelize([(i, f"a b c {i}") for i in range(50)], 64).toDF("id long, t string")
    built = text_index(corpus, "id", "t")
    text = spark._jvm.PythonSQLUtils.explainString(built._jdf.queryExecution(), "formatted")
    shuffled = re.findall(r"\) Exchange\s+Input \[\d+\]: \[(.*)\]", text)
    assert shuffled
    assert all(c.strip().split("#")[0] in ("id", "bucket", "cnt", "count", "buf", "sum") for out in shuffled for c in out.split(","))


def test_keyword_buckets_equal_the_column_function(spark):
    from refrank.functions.text import token_bucket

    words = ["the", "Energy", "x9"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select(token_bucket(F.lower("w")).alias("b")).collect()
    counts: dict[int, int] = {}
    for r in got:
        counts[r.b] = counts.get(r.b, 0) + 1
    assert keyword_buckets("the Energy, x9") == counts


def test_results_hold_every_paper_column(spark):
    papers = spark.createDataFrame(
        [(1, 2000, ["r"], 7.0), (2, 2001, None, 8.0)], "paper_id long, year int, `references` array<string>, similarity double"
    )
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "paper_id long, embedding array<double>")
    rows = rank_by_similarity(papers, vectors, [1.0, 0.0], k=2).collect()
    assert [(r.paper_id, r.references, r.similarity) for r in rows] == [(1, ["r"], 1.0), (2, None, 0.0)]
    assert order_by_field(papers, "year", k=1).collect()[0].asDict()["references"] is None
    authors = spark.createDataFrame([(5, "n")], "author_id long, name string")
    edges = spark.createDataFrame([(5, "liked", 1)], "author_id long, kind string, paper_id long")
    assert author_page(authors, edges, papers, 5).columns == ["author_id", "name", "kind", "paper_id", "year", "references", "similarity"]


def test_ranks_of_integers_that_share_a_double(spark):
    big = 1 << 53
    df = spark.createDataFrame([(1, big), (2, big + 1), (3, -(1 << 63)), (4, None)], "id long, v long")
    ranks = global_row_numbers(df, "id", [("down", "v", True), ("up", "v", False)])
    assert {r.id: (r.down, r.up) for r in ranks.collect()} == {1: (2, 3), 2: (1, 4), 3: (3, 2), 4: (4, 1)}


def test_pages_by_key_cover_the_table(spark):
    papers = spark.range(7).withColumnRenamed("id", "paper_id")
    seen, last = [], None
    while rows := page_after(papers, last, 3).collect():
        seen += [r.paper_id for r in rows]
        last = seen[-1]
    assert seen == list(range(7))


def test_missing_embeddings(spark):
    edges = spark.createDataFrame(
        [(1, "write", 1), (1, "liked", 2), (1, "write", 2), (1, "not liked", 3), (2, "liked", None)],
        "author_id long, kind string, paper_id long",
    )
    vectors = spark.createDataFrame([(1, [1.0]), (2, None)], "paper_id long, embedding array<double>")
    assert [tuple(r) for r in missing_embeddings(edges, vectors).collect()] == [(1, 2)]
