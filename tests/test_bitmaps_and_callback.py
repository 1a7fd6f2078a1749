"""Bitmap sets against plain joins on a hot author, and row callbacks from SQL."""

import random

import pytest
from pyspark.sql import functions as F

from refrank.functions.callback import register_callback
from refrank.operators import bitmaps as B

EDGES = "author_id long, kind string, paper_id long"


@pytest.fixture(scope="module")
def tables(spark):
    rnd = random.Random(2)
    papers = spark.range(0, 70_000 * 3, 3).select(F.col("id").alias("paper_id"))  # three ranges of numbers
    hot = [(1, rnd.choice(["write", "liked"]), 3 * rnd.randrange(70_000)) for _ in range(30_000)]
    rest = [(rnd.randrange(2, 30), rnd.choice(["write", "liked", "reference"]), 3 * rnd.randrange(70_000)) for _ in range(3000)]
    odd = [(2, "liked", None), (2, "liked", 1), (3, "liked", 0), (3, "liked", 3 * 69_999)]
    edges = spark.createDataFrame(hot + rest + odd, EDGES).checkpoint()
    return edges, B.number_papers(papers).checkpoint()


def test_union_over_kinds_counts_as_distinct_edges_do(spark, tables):
    edges, numbers = tables
    kinds = B.paper_bitmaps(edges, numbers, ("author_id", "kind"))
    assert kinds.groupBy("author_id", "kind").count().where("count > 3").count() == 0
    got = {r.author_id: r.n_papers for r in B.sizes(B.united(kinds)).collect()}
    want = edges.where("paper_id % 3 = 0").groupBy("author_id").agg(F.countDistinct("paper_id").alias("n"))
    assert got == {r.author_id: r.n for r in want.collect()} and got[1] > 20_000


def test_exclusion_equals_the_anti_join(spark, tables):
    edges, numbers = tables
    bits = B.paper_bitmaps(edges, numbers)
    pairs = numbers.select("paper_id").crossJoin(spark.createDataFrame([(1,), (3,), (99,)], "author_id long"))
    pairs = pairs.union(spark.createDataFrame([(1, 1), (2, 2)], "paper_id long, author_id long")).checkpoint()
    got = B.not_known(pairs, bits, numbers)
    want = pairs.join(edges.where("paper_id % 3 = 0").select("author_id", "paper_id").distinct(), ["author_id", "paper_id"], "left_anti")
    assert got.columns == pairs.columns and got.count() == want.count()
    assert got.exceptAll(want.select(*got.columns)).count() == 0
    assert got.where("author_id = 3 and paper_id in (0, 209997)").count() == 0


def test_cost_is_stated(tables):
    edges, numbers = tables
    assert 0.3 < B.bytes_per_edge(B.paper_bitmaps(edges.where("author_id = 1"), numbers)) < 0.7
    assert B.bytes_per_edge(B.paper_bitmaps(edges.where("author_id = 5"), numbers)) > 16


def running(row, state):
    state["n"] = state.get("n", 0) + 1
    state["sum"] = state.get("sum", 0) + row["v"]
    yield row["k"], state["n"], state["sum"]


def test_callback_runs_over_each_partition_in_order(spark):
    register_callback(spark, "running", running, "k int, n int, total int", last=lambda s: [(-1, s["n"], s["sum"])])
    spark.createDataFrame([(k % 3, i, i) for i, k in enumerate(range(30))], "g int, k int, v int").createOrReplaceTempView("callback_rows")
    got = spark.sql("SELECT * FROM running(TABLE(callback_rows) PARTITION BY g ORDER BY k)").collect()
    per = {g: [i for i in range(30) if i % 3 == g] for g in range(3)}
    want = [(k, n + 1, sum(ks[: n + 1])) for ks in per.values() for n, k in enumerate(ks)] + [(-1, 10, sum(ks)) for ks in per.values()]
    assert sorted(map(tuple, got)) == sorted(want)
    spark.sql("SELECT * FROM callback_rows WHERE g > 5").createOrReplaceTempView("callback_none")
    assert spark.sql("SELECT * FROM running(TABLE(callback_none) PARTITION BY g ORDER BY k)").count() == 0


def test_callback_state_is_bounded(spark):
    def hoard(row, state):
        state[row["k"]] = True
        return ()

    register_callback(spark, "hoard", hoard, "k int", max_state=5)
    spark.createDataFrame([(0, i) for i in range(10)], "g int, k int").createOrReplaceTempView("callback_many")
    with pytest.raises(Exception, match="beyond 5"):
        spark.sql("SELECT * FROM hoard(TABLE(callback_many) PARTITION BY g)").collect()


def test_a_paper_known_alone_takes_a_word_not_a_range(spark, tables):
    edges, numbers = tables
    lone = spark.createDataFrame([(a, 3 * (17 * a % 70_000)) for a in range(1, 500)], "author_id long, paper_id long")
    bits = B.paper_bitmaps(lone, numbers)
    assert bits.count() == 499 and bits.agg(F.max(F.size("bits"))).first()[0] == 1
    hot = B.paper_bitmaps(edges.where("author_id = 1"), numbers)
    assert hot.agg(F.max(F.size("bits"))).first()[0] <= 512
    every = numbers.select(F.lit(7).alias("author_id"), "paper_id")
    assert B.sizes(B.paper_bitmaps(every, numbers)).collect()[0].n_papers == 70_000
    assert B.not_known(every, B.paper_bitmaps(every, numbers), numbers).count() == 0
