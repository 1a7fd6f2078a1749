"""Packed rows and products in single precision: every row handed over once, results as in double precision."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from refrank.operators import counting as C
from refrank.operators import packed as K

STATIC = ["_r1", "_r2"]
WEIGHTS = [0.6, 0.3, 0.1]


def frame(spark, key, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"{key} long, embedding array<double>")


def _unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _near_ties(rng, n, dim):
    """Groups of vectors that differ by less than float32 can tell, some of them not at all."""
    x = np.repeat(rng.normal(size=(n // 6, dim)), 6, axis=0)
    return _unit(x + np.tile([0, 0, 1, 2, 3, 1], n // 6)[:, None] * 1e-9 * rng.normal(size=x.shape))


def _cells(rng, n_authors, n_papers, vectors, parts=2):
    authors = pd.DataFrame({"_kind": C.VECTOR, "author_id": np.arange(n_authors), "paper_id": -1})
    authors["embedding"] = list(_unit(rng.normal(size=(n_authors, vectors.shape[1]))))
    papers = pd.DataFrame({"paper_id": np.arange(n_papers), "embedding": list(vectors)})
    for c in STATIC:
        papers[c] = rng.permutation(n_papers) + 1
    known = pd.DataFrame({"author_id": rng.integers(0, n_authors, 4 * n_authors), "paper_id": rng.integers(0, n_papers, 4 * n_authors)})
    return authors, papers, known.drop_duplicates().assign(_kind=C.KNOWN, embedding=None)


def _with_counts(authors, known, papers, width):
    counted = C._count(STATIC, width)(None, pd.concat([authors, known]), papers)
    held = counted.groupby("author_id").agg(codes=("code", list), counts=("n", list)).reset_index()
    return authors.merge(held, on="author_id")


def test_exact_ranks_where_float32_cannot_tell(monkeypatch):
    monkeypatch.setattr(C, "TILE", (16, 64))
    monkeypatch.setattr(C, "ROWS", 4)
    monkeypatch.setattr(C, "CHUNK", (8, 32))
    rng = np.random.default_rng(11)
    n, k = 300, 12
    authors, papers, known = _cells(rng, 30, n, _near_ties(rng, n, 8))
    width = -(-n // C.BINS)
    full = _with_counts(authors, known, papers, width)
    found = C._bound(k, WEIGHTS, STATIC, width)(None, pd.concat([full, known]), papers)
    left = found.drop(columns=["low", "high"]).assign(_kind=C.SURVIVOR)
    counts = C._exact(STATIC)(None, pd.concat([authors, known, left]), papers)
    got = found.merge(counts, on=["author_id", "paper_id"])
    a, p = np.stack(authors["embedding"]), np.stack(papers["embedding"])
    for i in range(30):
        mine = set(known.loc[known["author_id"] == i, "paper_id"])
        sims = np.round((a[i] * p).sum(axis=1), C.PLACES)
        order = [j for j in np.lexsort((np.arange(n), -sims)) if j not in mine]
        place = {j: at for at, j in enumerate(order)}
        one = got[got["author_id"] == i]
        assert dict(zip(one["paper_id"], one["ahead"], strict=True)) == {j: place[j] for j in one["paper_id"]}
        exact = WEIGHTS[0] * (one["ahead"] + 1) + sum(w * (one[c] - one[f"x_{c}"]) for w, c in zip(WEIGHTS[1:], STATIC, strict=True))
        assert (one["low"] <= exact + 1e-9).all() and (exact <= one["high"] + 1e-9).all()
        cand = papers[~papers["paper_id"].isin(mine)]
        score = WEIGHTS[0] * (cand["paper_id"].map(place) + 1) + sum(w * cand[c].rank() for w, c in zip(WEIGHTS[1:], STATIC, strict=True))
        assert set(score.nsmallest(k).index) <= set(one["paper_id"])


def test_papers_out_of_reach_by_their_static_ranks_are_not_bounded(monkeypatch):
    rng = np.random.default_rng(3)
    n, k, seen = 6000, 5, []
    authors, papers, known = _cells(rng, 20, n, _unit(rng.normal(size=(n, 16))))
    width = -(-n // C.BINS)
    full = _with_counts(authors, known, papers, width)
    bins = C._similarity_bin
    monkeypatch.setattr(C, "_similarity_bin", lambda sims: seen.append(sims.size) or bins(sims))
    found = C._bound(k, WEIGHTS, STATIC, width)(None, pd.concat([full, known]), papers)
    assert found.groupby("author_id").size().min() >= k
    assert sum(seen) < 20 * n


def test_every_packed_row_is_handed_over_once(spark):
    rng = np.random.default_rng(2)
    authors = K.pack(K.with_known(frame(spark, "author_id", rng.normal(size=(20, 3))), None, None), K.block_of("author_id", 5), 2)
    papers = K.numbered(frame(spark, "paper_id", rng.normal(size=(70, 3))))
    papers = K.pack(papers, (F.col("_no") / 10).cast("int"), 3, "_no")
    parts = authors.rdd.getNumPartitions(), papers.rdd.getNumPartitions()
    met = K.pairs(authors, papers)
    assert {f.dataType.simpleString() for f in met.schema if "embedding" in f.name} == {"binary"}
    n = met.agg(F.count(F.lit(1)), F.count("a_embedding"), F.count("p_embedding")).first()
    assert parts == (2, 3) and tuple(n) == (authors.count() * 7, authors.count() * 3, 7 * 2)


@pytest.mark.parametrize("dim", [3, 64, 300])
def test_error_of_float32_products(dim):
    rng = np.random.default_rng(dim)
    a, p = _unit(rng.normal(size=(50, dim))), _unit(np.abs(rng.normal(size=(400, dim))))
    off = np.abs(a.astype(np.float32) @ p.astype(np.float32).T - a @ p.T).max()
    assert off <= K.error(dim)


@pytest.mark.parametrize("block", [7, 128])
def test_paper_block_bounds_a_product_and_not_the_tile(monkeypatch, block):
    """Small paper blocks (``batch_recommend_weighted_rounds``): many products, the counts of one tile taken at once."""
    rng = np.random.default_rng(4)
    n, width = 1000, 4
    authors, papers, known = _cells(rng, 10, n, _unit(rng.normal(size=(n, 8))))
    cell = C._cell(pd.concat([authors, known]), papers, STATIC)
    want = C._count(STATIC, width)(None, cell)
    cell.block, products, tiles = block, [], []
    matmul, bincount = np.matmul, np.bincount
    monkeypatch.setattr(np, "matmul", lambda a, b, out: products.append(b.shape[1]) or matmul(a, b, out=out))
    monkeypatch.setattr(np, "bincount", lambda x, minlength: tiles.append(len(x)) or bincount(x, minlength=minlength))
    got = C._count(STATIC, width)(None, cell)
    assert got.equals(want)
    assert max(products) == block and sum(products) == n and tiles == [10 * n]


def test_string_ids_stay_out_of_the_kernels(spark, monkeypatch):
    """String ids (``batch_recommend_weighted_string_ids``): numbered in their order, so kernels hold numbers alone."""
    rng = np.random.default_rng(6)
    text = lambda df, key: df.withColumn(key, F.format_string("id%03d", key))
    papers = text(frame(spark, "paper_id", _unit(rng.normal(size=(40, 4)))), "paper_id")
    papers = K.numbered(papers.orderBy(F.desc("paper_id")))
    assert [r.paper_id for r in papers.orderBy("_no").collect()] == [f"id{i:03d}" for i in range(40)]
    known = spark.createDataFrame([("id001", "id005"), ("id001", "id039"), ("id001", "id005"), ("id002", "none")], "author_id string, paper_id string")
    authors = K.with_known(text(frame(spark, "author_id", _unit(rng.normal(size=(3, 4)))), "author_id"), known, papers)
    held = K.pack(authors, F.lit(0), 1)
    row = K.Row(held.toArrow().to_batches()[0], 0, "")
    ids = row.ids("author_id").to_pylist()
    assert row.numbers("known").tolist() == [5, 39] and [ids[i] for i in row.numbers("known_at")] == ["id001", "id001"]
    ranked = papers.select("paper_id", "embedding", (F.col("_no") + 1).alias("_r1"))
    top = C.weighted_top_k(authors.select("author_id", "embedding"), ranked, known, 2, [0.0, 1.0], {"r": "_r1"}).collect()
    best = {(r.author_id, r.paper_id) for r in top}
    assert best == {(f"id{i:03d}", p) for i in range(3) for p in ("id000", "id001")}
