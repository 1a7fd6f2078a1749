"""Maintained ranks and invertible profile sums: equal to a rebuild, from the parts that change."""

import random

import pytest
from pyspark.sql import functions as F

from refrank.operators import accumulators as ACC
from refrank.operators import ordered as O
from refrank.operators.profiles import author_vectors
from refrank.sources.store import scratch_path

FIELD = "paper_id long, citation_count long"


def expected(rows, ascending=False):
    null_first = (lambda v: v is not None) if ascending else (lambda v: v is None)
    order = sorted(rows, key=lambda r: (null_first(r[1]), (r[1] or 0) if ascending else -(r[1] or 0), r[0]))
    return {(p, v, i + 1) for i, (p, v) in enumerate(order)}


def random_rows(seed, ids, hot=0.4):
    rnd = random.Random(seed)
    big = 2**53
    values = [None, 0, 1, 7, -3, big, big + 1, big + 2]
    return [(i, 5 if rnd.random() < hot else rnd.choice(values) if rnd.random() < 0.3 else rnd.randint(-50, 50)) for i in ids]


def stored(store):
    return {tuple(r) for r in O.ranks(store).collect()}


@pytest.mark.parametrize("ascending", [False, True])
def test_ranks_after_inserts_equal_a_rebuild(spark, ascending):
    rows = random_rows(1, range(0, 900, 2))
    path = scratch_path(spark, "ranks")
    store = O.build_ranks(spark.createDataFrame(rows, FIELD), path, "citation_count", ascending, range_rows=40)
    assert stored(store) == expected(rows, ascending)
    for seed, ids in ((2, range(1, 300, 2)), (3, range(301, 305, 2)), (4, [])):
        batch = random_rows(seed, ids)
        rows += batch
        store = O.insert_ranks(store, spark.createDataFrame(batch, FIELD))
        assert stored(store) == expected(rows, ascending) and store.rows == len(rows)
    again = O.open_ranks(spark, path, spark.createDataFrame([], FIELD).schema, ascending, range_rows=40)
    assert again.version == 3 and stored(again) == expected(rows, ascending)
    first = O.open_ranks(spark, path, spark.createDataFrame([], FIELD).schema, ascending, version=1)
    assert first.rows == 450  # an older version stays readable


def test_only_touched_ranges_are_rewritten(spark):
    rows = [(i, i) for i in range(1000)]
    store = O.build_ranks(spark.createDataFrame(rows, FIELD), scratch_path(spark, "ranks"), "citation_count", range_rows=50)
    before = {x[0] for x in store.lines}
    after = O.insert_ranks(store, spark.createDataFrame([(5000, 500), (5001, 500)], FIELD))
    kept = before & {x[0] for x in after.lines}
    assert len(before) == 20 and len(kept) == 19
    assert stored(after) == expected([*rows, (5000, 500), (5001, 500)])


def test_a_range_that_grows_is_split(spark):
    store = O.build_ranks(spark.createDataFrame([(0, 5)], FIELD), scratch_path(spark, "ranks"), "citation_count", range_rows=10)
    rows = [(i, 5) for i in range(1, 200)]
    store = O.insert_ranks(store, spark.createDataFrame(rows, FIELD))
    assert len(store.lines) == 20 and max(x[1] for x in store.lines) <= 20
    assert stored(store) == expected([(0, 5), *rows])


def test_deep_page_reads_its_ranges_only(spark):
    rows = random_rows(6, range(700))
    store = O.build_ranks(spark.createDataFrame(rows, FIELD), scratch_path(spark, "ranks"), "citation_count", range_rows=50)
    page = O.page(store, 333, 20)
    want = {r for r in expected(rows) if 333 < r[2] <= 353}
    assert {tuple(r) for r in page.collect()} == want
    plan = page._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters", 1)[1].split("PushedFilters", 1)[0]
    assert 1 <= sum(x[0] in filters for x in store.lines) <= 2
    assert O.page(store, 5000, 10).count() == 0


def test_ranks_start_empty_and_take_string_ids(spark):
    schema = "paper_id string, citation_count int, title string"
    store = O.build_ranks(spark.createDataFrame([], schema), scratch_path(spark, "ranks"), "citation_count")
    assert store.rows == 0 and O.ranks(store).count() == 0
    rows = [("b", 1, "x"), ("a", 1, "x"), ("é", None, None), ("c", 9, "x")]
    store = O.insert_ranks(store, spark.createDataFrame(rows, schema))
    assert stored(store) == {("c", 9, 1), ("a", 1, 2), ("b", 1, 3), ("é", None, 4)}


# ---------------------------------------------------------------- profile sums

EDGES = "author_id long, kind string, paper_id long"
DIM = 5


@pytest.fixture(scope="module")
def embeddings(spark):
    rnd = random.Random(9)
    rows = [(p, [rnd.uniform(-1, 1) for _ in range(DIM)]) for p in range(60)] + [(60, None)]
    return spark.createDataFrame(rows, "paper_id long, embedding array<double>")


def exact(df):
    return {(r.author_id, r.n, tuple(r.sums)) for r in df.collect()}


def recomputed(spark, edges, embeddings):
    """The sums of a store built afresh from all edges."""
    whole = ACC.build_profiles(spark.createDataFrame(sorted(edges), EDGES), embeddings, scratch_path(spark, "profiles"), 4)
    return exact(ACC.stored_sums(whole))


def test_changes_equal_a_recomputation_bit_by_bit(spark, embeddings):
    rnd = random.Random(3)
    kinds = ["write", "reference", "liked", "not liked"]
    edges = {(0 if rnd.random() < 0.4 else rnd.randrange(40), rnd.choice(kinds), rnd.randrange(65)) for _ in range(500)}
    path = scratch_path(spark, "profiles")
    store = ACC.build_profiles(spark.createDataFrame(sorted(edges), EDGES), embeddings, path, 8)
    for _ in range(3):
        gone = set(rnd.sample(sorted(edges), 60))
        fresh = {(rnd.randrange(45), rnd.choice(kinds), rnd.randrange(65)) for _ in range(60)}
        edges = (edges - gone) | fresh
        changes = [(*e[:2], e[2], False) for e in gone] + [(*e, True) for e in fresh] * 2
        store = ACC.apply_changes(store, spark.createDataFrame(changes, EDGES + ", present boolean"), embeddings)
        assert exact(ACC.stored_sums(store)) == recomputed(spark, edges, embeddings)
    held = {(r.author_id, r.paper_id, r.kinds) for r in ACC.stored_edges(store).collect()}
    want = {(a, p): 0 for a, _, p in edges}
    for a, k, p in edges:
        want[a, p] |= ACC.BITS[k]
    assert held == {(a, p, b) for (a, p), b in want.items()}
    vectors = {r.author_id: (r.n_embedded, [round(x, 7) for x in r.embedding]) for r in ACC.profile_vectors(store).collect()}
    again = author_vectors(spark.createDataFrame(sorted(edges), EDGES), embeddings)
    assert vectors == {r.author_id: (r.n_embedded, [round(x, 7) for x in r.embedding]) for r in again.collect()}
    opened = ACC.open_profiles(spark, path, *(store.edges.fields[i].dataType for i in (0, 1)), buckets=8)
    assert exact(ACC.stored_sums(opened)) == exact(ACC.stored_sums(store))


def test_like_and_clear_touch_their_buckets_only(spark, embeddings):
    edges = [(a, "write", a % 60) for a in range(100)]
    store = ACC.build_profiles(spark.createDataFrame(edges, EDGES), embeddings, scratch_path(spark, "profiles"), 16)
    liked = ACC.like(store, spark.createDataFrame([(7, 1), (7, 2), (7, 7), (7, 60)], "author_id long, paper_id long"), embeddings)
    assert sum(store.parts[b] != liked.parts[b] for b in store.parts) == 1
    one = ACC.stored_edges(liked, [b for b in store.parts if store.parts[b] != liked.parts[b]])
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and {r.author_id for r in one.collect()} < set(range(100))
    sums = {r.author_id: r.n for r in ACC.stored_sums(liked).collect()}
    assert sums[7] == 3 and sums[8] == 1  # 7 was known before, 60 has no vector
    cleared = ACC.clear(liked, spark.createDataFrame([(7,), (999,)], "author_id long"), embeddings)
    assert exact(ACC.stored_sums(cleared)) == exact(ACC.stored_sums(store))


def test_last_paper_gone_and_wrong_sizes(spark, embeddings):
    store = ACC.build_profiles(spark.createDataFrame([(1, "liked", 2), (1, "odd", 3), (2, "liked", None)], EDGES), embeddings, scratch_path(spark, "p"), 2)
    assert exact(ACC.stored_sums(store)) != set() and ACC.stored_edges(store).count() == 1
    assert ACC.stored_sums(ACC.clear(store, spark.createDataFrame([(1,)], "author_id long"), embeddings)).count() == 0
    none = ACC.build_profiles(spark.createDataFrame([], EDGES), embeddings, scratch_path(spark, "p"), 2)
    assert ACC.profile_vectors(none).count() == 0
    big = spark.createDataFrame([(2, [500.0])], "paper_id long, embedding array<double>")
    with pytest.raises(Exception, match="not below"):
        ACC.build_profiles(spark.createDataFrame([(1, "liked", 2)], EDGES), big, scratch_path(spark, "p"), 2)


def test_delete_takes_every_edge(spark, embeddings):
    edges = [(1, "write", 1), (1, "liked", 2), (1, "not liked", 3), (2, "write", 1), (3, "reference", 4)]
    store = ACC.build_profiles(spark.createDataFrame(edges, EDGES), embeddings, scratch_path(spark, "p"), 4)
    assert sorted(tuple(r) for r in ACC.edges_long(store).collect()) == sorted(edges)
    left = ACC.delete(store, spark.createDataFrame([(1,), (77,)], "author_id long"), embeddings)
    assert sorted(tuple(r) for r in ACC.edges_long(left).collect()) == edges[3:]
    assert exact(ACC.stored_sums(left)) == recomputed(spark, edges[3:], embeddings)


@pytest.mark.parametrize("dim", [1, ACC.CHUNK, 2 * ACC.CHUNK + 3])
def test_sums_take_one_row_a_chunk_whatever_the_width(spark, dim):
    rnd = random.Random(dim)
    vectors = {p: [rnd.uniform(-1, 1) for _ in range(dim)] for p in range(12)}
    emb = spark.createDataFrame([*vectors.items(), (12, []), (13, None)], "paper_id long, embedding array<double>")
    signed = sorted({(rnd.randrange(5), rnd.randrange(14)): rnd.choice([1, -1]) for _ in range(60)}.items())
    got = ACC.fixed_sums(spark.createDataFrame([(*k, s) for k, s in signed], "author_id long, paper_id long, sign long"), emb)
    want = {}
    for (a, p), sign in signed:
        if p < 12:
            n, line = want.get(a, (0, [0] * dim))
            want[a] = (n + sign, [x + sign * round(v * 2**32) for x, v in zip(line, vectors[p], strict=True)])
    assert {r.author_id: (r.n, r.sums) for r in got.collect()} == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode(transform(" in plan and "posexplode(q" not in plan
