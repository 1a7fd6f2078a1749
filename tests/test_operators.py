"""Operator unit tests on hand-made rows (the edge cases listed in FIXTURES.md §3)."""

import warnings

import pytest
from pyspark.sql import functions as F

from refrank.functions.text import segments
from refrank.functions.vectors import check_weights, cosine, cosine_to_constant
from refrank.operators import mutations as M
from refrank.operators import papers as P
from refrank.operators import profiles as PR
from refrank.operators.embedding import bucket_counts, pool_segment_vectors
from refrank.plans import recommend
from refrank.sources.json_papers import read_paper_pages, to_store_columns

PAPER_DDL = (
    "paper_id string, title string, abstract string, year int, reference_count long, "
    "citation_count long, influential_citation_count long"
)


def test_first_seen_keeps_first_file(spark):
    df = spark.createDataFrame(
        [("b.json", 0, "x", "second"), ("a.json", 0, "x", "first"), ("a.json", 1, "y", "only")],
        "file string, pos int, paper_id string, title string",
    )
    got = {r.paper_id: r.title for r in P.first_seen(df, "paper_id", ["file", "pos"]).collect()}
    assert got == {"x": "first", "y": "only"}


def test_insert_or_ignore_existing_wins(spark):
    old = spark.createDataFrame([("x", "old")], "paper_id string, title string")
    new = spark.createDataFrame([("x", "new", 0), ("z", "z2", 2), ("z", "z1", 1)], "paper_id string, title string, pos int")
    add = P.insert_or_ignore(old, new, "paper_id", ["pos"]).collect()
    assert [(r.paper_id, r.title) for r in add] == [("z", "z1")]


def _nested(spark, rows):
    return spark.createDataFrame(
        rows,
        "paper_id string, authors array<struct<authorId:string,name:string>>, references array<struct<paperId:string>>",
    )


def test_profiles_skip_null_author_and_null_reference(spark):
    nested = _nested(spark, [("p0", [(None, "N"), ("1", "A")], [("p", ), (None,)])])
    names, edges = PR.profiles_from_papers(nested)
    assert [(r.author_id, r.name) for r in names.collect()] == [("1", "A")]
    assert sorted(tuple(r) for r in edges.collect()) == [("1", "reference", "p"), ("1", "write", "p0")]


def test_profiles_first_spelling_wins(spark):
    nested = _nested(spark, [("p2", [("1", "Ann B")], []), ("p1", [("1", "A. B")], [])])
    names, _ = PR.profiles_from_papers(nested)
    assert names.collect()[0].name == "A. B"


def test_content_null_abstract(spark):
    df = spark.createDataFrame([("t", None), ("t", "a")], "title string, abstract string")
    assert [r[0] for r in df.select(P.content_text()).collect()] == ["t", "ta"]


@pytest.mark.parametrize("n,expected", [(0, 0), (1, 1), (2750, 1), (2751, 2), (5500, 2), (5501, 3)])
def test_segment_counts(spark, n, expected):
    df = spark.createDataFrame([("x" * n,)], "text string")
    segs = df.select(segments("text").alias("s")).first().s
    assert len(segs) == expected
    assert all(len(s) <= 5500 for s in segs)
    if n:
        assert segs[0] == "x" * min(n, 5500)


def test_null_text_has_no_segments(spark):
    df = spark.createDataFrame([(None,)], "text string")
    assert df.select(F.size(segments("text"))).first()[0] == 0


def test_zero_vector_similarity(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert df.select(cosine("a", "b")).first()[0] == 0.0
    assert df.select(cosine_to_constant("a", [1.0, 0.0])).first()[0] == 0.0
    assert df.select(cosine_to_constant("b", [0.0, 0.0])).first()[0] == 0.0


def test_pooling_width_and_mean(spark):
    df = spark.createDataFrame([("d", [1.0, 0.0]), ("d", [0.0, 1.0])], "k string, embedding array<double>")
    assert pool_segment_vectors(df, "k").first().embedding == [0.5, 0.5]
    three = spark.createDataFrame([("d", [1.0, 0.0])] * 3, "k string, embedding array<double>")
    assert pool_segment_vectors(three, "k").first().embedding == [1.5, 0.0]
    assert pool_segment_vectors(three, "k", pooling="mean").first().embedding == [1.0, 0.0]


def _papers(spark):
    return spark.createDataFrame(
        [
            ("a", "same", None, 2001, 5, 1, 0),
            ("b", "same", "x", 2001, 5, 2, 0),
            ("c", "other", "y", None, 1, 3, 1),
        ],
        PAPER_DDL,
    )


def test_ties_and_null_year_order(spark):
    papers = _papers(spark)
    desc = [r.paper_id for r in recommend.order_by_field(papers, "year").collect()]
    assert desc == ["a", "b", "c"]  # tie on 2001 broken by id; NULL last under desc
    asc = [r.paper_id for r in recommend.order_by_field(papers, "year", ascending=True).collect()]
    assert asc == ["c", "a", "b"]  # NULL first under asc
    with pytest.raises(ValueError):
        recommend.order_by_field(papers, "title")


def test_empty_exclusion_and_exclusion(spark):
    papers = _papers(spark)
    emb = spark.createDataFrame(
        [("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [1.0, 1.0])], "paper_id string, embedding array<double>"
    )
    allp = recommend.rank_by_similarity(papers, emb, [1.0, 0.0], None, k=10).collect()
    assert [r.paper_id for r in allp] == ["a", "c", "b"]
    known = spark.createDataFrame([("a",)], "paper_id string")
    some = recommend.rank_by_similarity(papers, emb, [1.0, 0.0], known, k=10).collect()
    assert [r.paper_id for r in some] == ["c", "b"]


def test_unknown_author(spark):
    authors = spark.createDataFrame([("1", "Ann")], "author_id string, name string")
    with pytest.raises(ValueError):
        PR.require_author(authors, "2")
    inter = spark.createDataFrame([("1", "liked", "p")], "author_id string, kind string, paper_id string")
    assert M.clear_liked(inter, "2").count() == 1
    assert M.clear_liked(inter, "1").count() == 0


def test_author_without_embedded_paper(spark):
    inter = spark.createDataFrame([("1", "write", "p")], "author_id string, kind string, paper_id string")
    emb = spark.createDataFrame([("q", [1.0])], "paper_id string, embedding array<double>")
    with pytest.raises(ValueError):
        recommend.author_query_vector(inter, emb, "1")


def test_not_liked_excluded_but_not_averaged(spark):
    inter = spark.createDataFrame(
        [("1", "write", "a"), ("1", "not liked", "b")], "author_id string, kind string, paper_id string"
    )
    emb = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "paper_id string, embedding array<double>")
    assert recommend.author_query_vector(inter, emb, "1") == [1.0, 0.0]
    assert {r.paper_id for r in PR.known_papers(inter, "1").collect()} == {"a", "b"}


def test_like_by_title_marks_both_duplicates(spark):
    recs = spark.createDataFrame([("p1", "t"), ("p2", "t"), ("p3", "u")], "paper_id string, title string")
    liked = P.ids_by_title(recs, ["t"])
    authors = spark.createDataFrame([("1", "A")], "author_id string, name string")
    inter = spark.createDataFrame([("1", "write", "p9")], "author_id string, kind string, paper_id string")
    _, inter2 = M.like_papers(authors, inter, "1", liked)
    assert sorted(r.paper_id for r in inter2.where("kind = 'liked'").collect()) == ["p1", "p2"]


def test_upsert_twice_equals_once_and_keeps_name(spark):
    authors = spark.createDataFrame([("1", "Old")], "author_id string, name string")
    inter = spark.createDataFrame([("1", "write", "a")], "author_id string, kind string, paper_id string")
    b_auth = spark.createDataFrame([("1", "New"), ("2", "Two")], "author_id string, name string")
    b_edges = spark.createDataFrame(
        [("1", "write", "a"), ("1", "liked", "b"), ("2", "write", "c")], "author_id string, kind string, paper_id string"
    )
    a1, i1 = M.upsert_profiles(authors, inter, b_auth, b_edges)
    a2, i2 = M.upsert_profiles(a1, i1, b_auth, b_edges)
    assert sorted(tuple(r) for r in a1.collect()) == sorted(tuple(r) for r in a2.collect()) == [("1", "Old"), ("2", "Two")]
    assert sorted(tuple(r) for r in i1.collect()) == sorted(tuple(r) for r in i2.collect())
    assert i1.count() == 3


def test_sign_up_seed_and_delete(spark):
    authors = spark.createDataFrame([("1", "A")], "author_id string, name string")
    inter = spark.createDataFrame([("1", "write", "a")], "author_id string, kind string, paper_id string")
    new = spark.createDataFrame([("7", "Neo")], "author_id string, name string")
    a2, i2 = M.sign_up(authors, inter, new, ["seed"])
    assert sorted(tuple(r) for r in i2.where("author_id = '7'").collect()) == [("7", "write", "seed")]
    a3, i3 = M.delete_profiles(a2, i2, ["7"])
    assert a3.count() == 1 and i3.count() == 1


def test_free_and_allocated_ids(spark):
    authors = spark.createDataFrame([(str(i), "x") for i in range(9990)], "author_id string, name string")
    free = {r.author_id for r in M.free_ids(authors).collect()}
    assert free == {str(i) for i in range(9990, 10000)}
    got = [r.author_id for r in M.allocate_ids(authors, 3, seed=1).collect()]
    assert len(set(got)) == 3 and set(got) <= free


def test_weight_check_warns_only():
    with warnings.catch_warnings(record=True) as w:
        warnings.simplefilter("always")
        assert check_weights([0.6, 0.1, 0.1, 0.1, 0.1])
        assert not check_weights([1, 1, 1, 1, 1])
        assert len(w) == 1


def test_name_search_like_and_literal(spark):
    authors = spark.createDataFrame([("1", "Ann Lee"), ("2", "a_n"), ("3", "BOB")], "author_id string, name string")
    assert {r.author_id for r in PR.search_by_name(authors, "ann").collect()} == {"1"}
    assert {r.author_id for r in PR.search_by_name(authors, "a_n").collect()} == {"1", "2"}  # _ is a wildcard
    assert {r.author_id for r in PR.search_by_name(authors, "a_n", literal=True).collect()} == {"2"}
    assert {r.author_id for r in PR.search_by_name(authors, "bob").collect()} == {"3"}


def test_bucket_counts_ascii_tokens(spark):
    df = spark.createDataFrame([("d", "Hello, hello WORLD!! ")], "k string, text string")
    rows = bucket_counts(df, ["k"], "text").collect()
    assert sum(r.cnt for r in rows) == 3


def test_json_pages_source(spark, tmp_path):
    (tmp_path / "machine learning-0-1.json").write_text(
        '[{"paperId":"p1","title":"T","year":2020,"referenceCount":3,'
        '"authors":[{"authorId":"1","name":"A"}],"references":[{"paperId":"p0"}]},'
        '{"title":"U","paperId":"p2","authors":[],"references":[]}]'
    )
    df = read_paper_pages(spark, str(tmp_path))
    rows = df.orderBy("pos").collect()
    assert [r.paperId for r in rows] == ["p1", "p2"]
    assert rows[0].query == "machine learning" and rows[0].offset_to == "1"
    stored = to_store_columns(df).orderBy("paper_id").first()
    assert stored.reference_count == 3 and stored.authors[0].name == "A"


def _char_model(texts):
    import numpy as np

    return np.array([[t.count("a"), t.count("b")] for t in texts], dtype=float)


def test_batch_embedder_segments_and_pools(spark):
    from refrank.operators.embedding import BatchEmbedder

    text = "a" * 3000 + "b" * 3000  # 6000 chars -> 3 segments starting at 0, 2750, 5500
    df = spark.createDataFrame([("d", text), ("e", "ab")], "k string, text string")
    got = {r.k: r.embedding for r in BatchEmbedder(_char_model, 2).embed(df, "k", "text").collect()}
    segs = [text[i:i + 5500] for i in range(0, len(text), 2750)]
    want = [sum(s.count("a") for s in segs) / 2, sum(s.count("b") for s in segs) / 2]
    assert got["d"] == want and got["e"] == [0.5, 0.5]
    mean = {r.k: r.embedding for r in BatchEmbedder(_char_model, 2, pooling="mean").embed(df, "k", "text").collect()}
    assert mean["d"] == [want[0] * 2 / 3, want[1] * 2 / 3]


def test_recommend_mode_switch(spark):
    from refrank.sources.testdata import TestTables

    t = TestTables(spark, "/root/testdata/sf0.001")
    a = recommend.recommend(t.papers, t.paper_embeddings, t.interactions, 7, mode="weighted").collect()
    b = recommend.recommend_weighted(t.papers, t.paper_embeddings, t.interactions, 7).collect()
    assert [r.paper_id for r in a] == [r.paper_id for r in b]
    with pytest.raises(ValueError):
        recommend.recommend(t.papers, t.paper_embeddings, t.interactions, 7, mode="other")


def test_null_embedding_counts_as_not_embedded(spark):
    from refrank.plans.batch import batch_recommend_cosine

    papers = _papers(spark)
    emb = spark.createDataFrame(
        [("a", [1.0, 0.0]), ("b", None), ("c", [1.0, 1.0])], "paper_id string, embedding array<double>"
    )
    inter = spark.createDataFrame([("1", "write", "a"), ("1", "write", "b")], "author_id string, kind string, paper_id string")
    assert recommend.author_query_vector(inter, emb, "1") == [1.0, 0.0]
    assert [r.paper_id for r in recommend.rank_by_similarity(papers, emb, [1.0, 0.0], None).collect()] == ["a", "c"]
    assert [r.paper_id for r in batch_recommend_cosine(papers, emb, inter).collect()] == ["c"]
    cov = PR.profile_coverage(inter, emb).first()
    assert (cov.n_papers, cov.n_embedded, cov.n_missing) == (2, 1, 1)


def test_papers_by_id_set_edges(spark):
    papers = _papers(spark)
    assert P.papers_by_ids(papers, []).count() == 0
    assert sorted(r.paper_id for r in P.papers_by_ids(papers, ["a", "zz", None]).collect()) == ["a"]
    ids = spark.createDataFrame([("c",), ("c",), ("nope",)], "paper_id string")
    assert [r.paper_id for r in P.papers_by_ids(papers, ids).collect()] == ["c"]


def test_name_search_backslash_is_literal(spark):
    authors = spark.createDataFrame([("1", "a\\b"), ("2", "ab")], "author_id string, name string")
    assert {r.author_id for r in PR.search_by_name(authors, "a\\b").collect()} == {"1"}


def test_known_papers_unknown_author_raises(spark):
    authors = spark.createDataFrame([("1", "Ann"), ("2", "Bo")], "author_id string, name string")
    inter = spark.createDataFrame([("1", "write", "p")], "author_id string, kind string, paper_id string")
    assert PR.author_known_papers(inter, "2", authors).count() == 0  # exists, knows nothing
    with pytest.raises(ValueError):
        PR.author_known_papers(inter, "3", authors)


def test_landing_pages_computes_its_input_once(spark, tmp_path):
    from refrank.sources.json_papers import write_paper_pages

    seen = spark.sparkContext.accumulator(0)

    def watch(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.range(250).selectExpr("cast(id as string) AS paperId", "cast(id as int) AS year")
    write_paper_pages(rows.mapInArrow(watch, rows.schema), str(tmp_path / "pages"))
    assert seen.value == 250


def test_upsert_of_most_authors_reads_its_batch_once(spark):
    """Without the trim the same edges are new, and neither side meets the other's authors."""
    schema = "author_id long, kind string, paper_id long"
    store = [(1, "write", 1), (1, "write", 1), (1, None, 2), (None, "liked", 3), (2, "liked", None), (3, "write", 9)]
    batch = [(1, "write", 1), (1, "write", 2), (1, "write", 2), (1, None, 2), (None, "liked", 3), (2, "liked", None), (4, "liked", 9)]
    store, batch = spark.createDataFrame(store, schema), spark.createDataFrame(batch, schema)
    rows = lambda df: sorted(df.collect(), key=str)
    fresh = M.new_edges(store, batch, trim=False)
    assert rows(fresh) == rows(M.new_edges(store, batch)) and fresh.where("author_id = 1 and paper_id = 1").isEmpty()
    plan = fresh._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" not in plan and plan.count("LogicalRDD") + plan.count("LocalRelation") == 2
    names = spark.createDataFrame([(4, "d")], "author_id long, name string")
    got = M.upsert_profiles(names.limit(0), store, names, batch, trim=False)[1]
    assert rows(got) == rows(M.upsert_profiles(names.limit(0), store, names, batch)[1])
