"""Trigram postings give what the full scan gives; allocated ids are distinct, unused and spread."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from refrank.operators import allocation as AL
from refrank.operators import names as N
from refrank.operators.profiles import search_by_name
from refrank.sources.store import scratch_path

NAMES = ["Ada Lovelace", "ada  lovelace", "A%da", "under_score", "back\\slash", "Jo", "", None, "Élodie Çelik", "élan", "李小龍先生", "STRASSE", "Straße", "İstanbul", "anna banana", "x" * 300]
PATTERNS = ["ada", "LOVE", "a%la", "%", "_", "", "l_ve", "a%da", "under_s", "back\\sl", "\\", "jo", "élo", "ÇELIK", "小龍先", "龍", "strasse", "straß", "istanbul", "nan%nan", "ana", "zzz", "xxxx", "lo__la"]


@pytest.fixture(scope="module")
def authors(spark):
    rows = [(i, n) for i, n in enumerate(NAMES)] + [(None, "Ada Nobody")] + [(100 + i, f"Filler {i:03d}") for i in range(200)]
    return spark.createDataFrame(rows, "author_id long, name string")


@pytest.fixture(scope="module")
def index(spark, authors):
    return N.build_name_index(authors, scratch_path(spark, "names"), buckets=8)


def test_rows_equal_the_scan(authors, index):
    known = authors.where("author_id is not null")
    for pattern in PATTERNS:
        for literal in (False, True):
            want = sorted(tuple(r) for r in search_by_name(known, pattern, literal).collect())
            got = sorted(tuple(r) for r in N.search_names(index, pattern, literal).collect())
            assert got == want, (pattern, literal)


def test_only_postings_of_the_pattern_are_read(index):
    plan = N.search_names(index, "fill_r 01")._jdf.queryExecution().executedPlan().toString()
    parts = plan.split("PartitionFilters")[1:]
    assert any("bucket" in p.split("PushedFilters")[0] and "In(trigram" in p.split("PushedFilters")[1][:400] for p in parts)


def test_trigrams(spark):
    rows = spark.createDataFrame([("abcABC",), ("ab",), ("",), ("a😀b龍",)], "t string").select(N.trigrams(F.col("t")).alias("g"))
    assert [r.g for r in rows.collect()] == [["abc", "bca", "cab"], [], [], ["a😀b", "😀b龍"]]


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 4097])
def test_permutation(n):
    image = AL.permuted(np.arange(n), n, 5)
    assert sorted(image.tolist()) == list(range(n))
    assert n < 1000 or (image != AL.permuted(np.arange(n), n, 6)).any()


@pytest.mark.parametrize("kind", ["long", "string"])
def test_ids_are_distinct_unused_and_inside(spark, kind, monkeypatch):
    monkeypatch.setattr(AL, "LEAST_RANGE", 16)
    held = [3, 3, 5, -1, 250, 10_000] + list(range(100, 200))
    authors = spark.createDataFrame([(h,) for h in held], "author_id long").select(F.col("author_id").cast(kind))
    if kind == "string":
        authors = authors.union(spark.createDataFrame([("no number",), (None,)], "author_id string"))
    every = {int(r.author_id) for r in AL.allocate_ids(authors, 150, seed=1, id_space=252).collect()}
    space = max(252, authors.count() + 150)
    assert len(every) == 150 and not every & set(held) and every <= set(range(space))
    # all that is free can be given out
    free = set(range(space)) - set(held)
    rest = AL.allocate_ids(spark.createDataFrame([(h,) for h in set(held) & set(range(space))], "author_id long"), len(free), id_space=space)
    given = [r.author_id for r in rest.collect()]
    assert len(set(given)) == len(given) == len(free)
    assert AL.allocate_ids(authors, 0).count() == 0


def test_sign_ups_get_one_id_each_over_many_tasks(spark):
    signups = spark.range(3000).select(F.concat(F.lit("user "), F.col("id").cast("string")).alias("name"))
    authors = spark.range(500).select(F.col("id").alias("author_id"))
    out = AL.sign_up_ids(signups, authors, ["name"])
    rows = out.collect()
    assert len(rows) == 3000 == len({r.name for r in rows}) == len({r.author_id for r in rows})
    assert min(r.author_id for r in rows) >= 500
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "SinglePartition" not in plan.replace("Exchange SinglePartition, ENSURE", "")
