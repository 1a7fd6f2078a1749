"""SQL surface, result cache, initialise-all, page scan, release and vector sources, C6."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from refrank.operators.papers import page
from refrank.plans import recommend
from refrank.plans.initialize import initialize
from refrank.plans.profile_pages import find_and_recommend
from refrank.plans.sql import query, register_functions, register_views
from refrank.sources.cache import ResultCache
from refrank.sources.json_papers import read_release, read_vector_responses
from refrank.sources.store import VersionedTable, scratch_path
from refrank.sources.testdata import TestTables

SF = "/root/testdata/sf0.001"


def test_sql_functions_reproduce_weighted_model(spark):
    t = TestTables(spark, SF)
    register_views({"paper": t.papers, "emb": t.paper_embeddings, "inter": t.interactions})
    register_functions(spark)
    q = recommend.author_query_vector(t.interactions, t.paper_embeddings, 7)
    spark.createDataFrame([(q,)], "q array<double>").createOrReplaceTempView("qv")
    sql = """
      SELECT paper_id, linear_combination_score(cos_rank, ref_rank, cite_rank, inf_cite_rank, year_rank) AS rank
      FROM (SELECT *, row_number() OVER (ORDER BY similarity DESC, paper_id) AS cos_rank,
                      row_number() OVER (ORDER BY reference_count DESC, paper_id) AS ref_rank,
                      row_number() OVER (ORDER BY citation_count DESC, paper_id) AS cite_rank,
                      row_number() OVER (ORDER BY influential_citation_count DESC, paper_id) AS inf_cite_rank,
                      row_number() OVER (ORDER BY year DESC, paper_id) AS year_rank
            FROM (SELECT p.*, cosine_similarity(e.embedding, qv.q) AS similarity
                  FROM paper p JOIN emb e ON p.paper_id = e.paper_id JOIN qv ON true
                  WHERE p.paper_id NOT IN (SELECT paper_id FROM inter WHERE author_id = :author)))
      ORDER BY rank, paper_id LIMIT 10"""
    via_sql = [(r.paper_id, round(r.rank, 6)) for r in query(spark, sql, author=7).collect()]
    via_df = recommend.recommend_weighted(t.papers, t.paper_embeddings, t.interactions, 7).collect()
    assert via_sql == [(r.paper_id, round(r.rank, 6)) for r in via_df]


def test_result_cache_keyed_by_everything(spark):
    cache = ResultCache(spark, scratch_path(spark, "cache"))
    calls = []

    def compute(v):
        def run():
            calls.append(v)
            return spark.createDataFrame([(v,)], "v long")

        return run

    a = cache.get_or_compute(compute(1), author=7, mode="cosine", version=1).first().v
    b = cache.get_or_compute(compute(2), author=7, mode="cosine", version=1).first().v
    c = cache.get_or_compute(compute(3), author=8, mode="cosine", version=1).first().v
    assert (a, b, c) == (1, 1, 3) and calls == [1, 3]


def test_versioned_table(spark):
    vt = VersionedTable(spark, scratch_path(spark, "vt"), spark.createDataFrame([], "x long").schema)
    assert vt.current().count() == 0
    vt.commit(spark.range(3).withColumnRenamed("id", "x"))
    v2 = vt.current().where("x > 0")
    vt.commit(v2)  # read version 1, write version 2: never the same path
    assert sorted(r.x for r in vt.current().collect()) == [1, 2]


def test_initialize_from_pages(spark, tmp_path):
    recs = [
        {"paperId": "p1", "title": "Graph nets", "abstract": "learning on graphs", "year": 2020,
         "referenceCount": 1, "citationCount": 5, "influentialCitationCount": 1,
         "authors": [{"authorId": "a1", "name": "Ann"}, {"authorId": None, "name": "Anon"}],
         "references": [{"paperId": "p2"}, {"paperId": None}]},
        {"paperId": "p2", "title": "Trees", "abstract": None, "year": 2019,
         "authors": [{"authorId": "a1", "name": "A. N."}], "references": []},
    ]
    (tmp_path / "ml-0-1.json").write_text(json.dumps(recs))
    (tmp_path / "ml-2-3.json").write_text(json.dumps([dict(recs[0], title="duplicate")]))
    out = initialize(spark, str(tmp_path), scratch_path(spark, "init"))
    assert {r.paper_id: r.title for r in out["papers"].collect()} == {"p1": "Graph nets", "p2": "Trees"}
    assert [tuple(r) for r in out["authors"].collect()] == [("a1", "Ann")]
    assert sorted(tuple(r) for r in out["interactions"].collect()) == [
        ("a1", "reference", "p2"), ("a1", "write", "p1"), ("a1", "write", "p2")
    ]
    assert out["paper_embeddings"].count() == 2


def test_page_scan(spark):
    papers = spark.range(25).select(F.col("id").alias("paper_id"))
    assert [r.paper_id for r in page(papers, 10, 5).collect()] == [10, 11, 12, 13, 14]


def test_release_and_vector_sources(spark, tmp_path):
    rel = tmp_path / "rel"
    rel.mkdir()
    with gzip.open(rel / "part0.jsonl.gz", "wt") as f:
        for i in range(5):
            f.write(json.dumps({"paperId": f"p{i}", "title": f"t{i}", "year": 2000 + i}) + "\n")
    df = read_release(spark, str(rel), partitions=4)
    assert df.rdd.getNumPartitions() == 4 and df.count() == 5
    vec = tmp_path / "vec"
    vec.mkdir()
    (vec / "v.json").write_text(json.dumps({"paperId": "p1", "embedding": {"model": "m", "vector": [0.5, 1.5]}}))
    assert [tuple(r) for r in read_vector_responses(spark, str(vec)).collect()] == [("p1", [0.5, 1.5])]


def test_find_then_recommend(spark):
    t = TestTables(spark, SF)
    got = find_and_recommend(t.authors, t.papers, t.paper_embeddings, t.interactions, "Customer#000000007")
    want = recommend.recommend_to_author(t.papers, t.paper_embeddings, t.interactions, 7)
    assert [r.paper_id for r in got.collect()] == [r.paper_id for r in want.collect()]
    with pytest.raises(ValueError):
        find_and_recommend(t.authors, t.papers, t.paper_embeddings, t.interactions, "Customer#0000000")


def test_stream_ingest_existing_rows_win_across_batches(spark, tmp_path):
    from pyspark.sql import types as T

    from refrank.sources.store import create_table
    from refrank.streaming.ingest import run_paper_ingest

    schema = T.StructType(
        [T.StructField("paper_id", T.LongType()), T.StructField("pos", T.LongType()), T.StructField("title", T.StringType())]
    )
    landing = tmp_path / "landing"
    landing.mkdir()
    (landing / "a.json").write_text('{"paper_id": 1, "pos": 10, "title": "first batch"}\n{"paper_id": 2, "pos": 11, "title": "x"}\n')
    store = scratch_path(spark, "ingest-store")
    create_table(spark, store, schema)
    ckpt = scratch_path(spark, "ingest-ckpt")
    run_paper_ingest(spark, str(landing), schema, store, ckpt, max_files=1)
    # A later file with a smaller position for paper 1: the stored row still wins (insert-or-ignore);
    # inside the batch, the first position wins for paper 3.
    (landing / "b.json").write_text(
        '{"paper_id": 1, "pos": 1, "title": "later"}\n{"paper_id": 3, "pos": 7, "title": "p3 second"}\n'
        '{"paper_id": 3, "pos": 5, "title": "p3 first"}\n'
    )
    run_paper_ingest(spark, str(landing), schema, store, ckpt, max_files=1)
    got = {r.paper_id: r.title for r in spark.read.schema(schema).parquet(store).collect()}
    assert got == {1: "first batch", 2: "x", 3: "p3 first"}
    # Re-running with nothing new changes nothing (exactly-once through the stream checkpoint).
    run_paper_ingest(spark, str(landing), schema, store, ckpt, max_files=1)
    assert spark.read.schema(schema).parquet(store).count() == 3


def test_index_search_equals_dense_paper_search(spark):
    from refrank.operators.embedding import HashEmbedder
    from refrank.operators.papers import content_text
    from refrank.plans.search import search_index, search_papers, text_index

    t = TestTables(spark, SF)
    corpus = t.papers.select("paper_id", content_text().alias("content"))
    keyword = "blue widget ECONOMY"
    sparse = search_index(text_index(corpus, "paper_id", "content"), "paper_id", keyword).collect()
    vectors = HashEmbedder().embed(corpus, "paper_id", "content")
    dense = search_papers(t.papers, vectors, keyword).collect()
    assert [round(r.similarity, 9) for r in sparse] == [round(r.similarity, 9) for r in dense]
    assert sparse[0].similarity > 0


def test_bucketed_store_join_shuffles_only_the_batch(spark):
    from refrank.operators.mutations import new_edges
    from refrank.sources.store import write_bucketed

    t = TestTables(spark, SF)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # force a shuffle join to inspect
    try:
        store = write_bucketed(
            t.interactions, "interactions_bucketed", scratch_path(spark, "bucketed"), "author_id", 8
        )
        batch = spark.createDataFrame([(7, "liked", 1), (8, "liked", 2)], "author_id long, kind string, paper_id long")
        joined = store.join(batch, "author_id")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        # Exactly one shuffle: the batch's. The bucketed store is read already partitioned.
        assert plan.count("Exchange hashpartitioning") == 1
        assert new_edges(store, batch).count() == 2 - store.join(batch, ["author_id", "kind", "paper_id"]).count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE IF EXISTS interactions_bucketed")


def test_like_stream_into_bucketed_store(spark):
    from refrank.sources.store import write_bucketed
    from refrank.streaming.likes import run_like_stream

    t = TestTables(spark, SF)
    empty = spark.createDataFrame([], "author_id long, kind string, paper_id long")
    path = scratch_path(spark, "likes-bucketed")
    try:
        write_bucketed(empty, "likes_bucketed", path, "author_id", 4)
        run_like_stream(spark, f"{SF}/events*.parquet", path, scratch_path(spark, "likes-bk-ckpt"), table="likes_bucketed")
        got = {tuple(r) for r in spark.table("likes_bucketed").collect()}
        want = {(r.author_id, "liked", r.paper_id) for r in t.like_events.select("author_id", "paper_id").distinct().collect()}
        assert got == want
    finally:
        spark.sql("DROP TABLE IF EXISTS likes_bucketed")
