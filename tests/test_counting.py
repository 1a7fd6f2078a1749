"""The kernels of the counting plan on their own: what leaves a cell, and exact ranks under ties."""

import numpy as np
import pandas as pd
import pytest

from refrank.operators import counting as C

STATIC = ["_r1", "_r2"]
WEIGHTS = [0.6, 0.3, -0.1]


def _fixture(n_authors, n_papers, dim, ties):
    rng = np.random.default_rng(5)

    def vectors(n):
        v = np.ones((n, dim)) if ties else rng.normal(size=(n, dim))
        return list(v / np.linalg.norm(v, axis=1, keepdims=True))

    papers = pd.DataFrame({"paper_id": np.arange(n_papers), "embedding": vectors(n_papers)})
    for c in STATIC:
        papers[c] = rng.permutation(n_papers) + 1
    authors = pd.DataFrame({"_kind": C.VECTOR, "author_id": np.arange(n_authors), "paper_id": -1, "embedding": vectors(n_authors)})
    known = pd.DataFrame({"author_id": rng.integers(0, n_authors, 6 * n_authors), "paper_id": rng.integers(0, n_papers, 6 * n_authors)})
    known = known.drop_duplicates().assign(_kind=C.KNOWN, embedding=None)
    return authors, papers, known


def _bounded(authors, papers, known, k):
    """The first two passes over cells of half the papers each."""
    width = -(-len(papers) // C.BINS)
    cells = [papers[papers["paper_id"] % 2 == h] for h in (0, 1)]
    edges = [known[known["paper_id"] % 2 == h] for h in (0, 1)]
    counted = pd.concat([C._count(STATIC, width)(None, pd.concat([authors, e]), p) for p, e in zip(cells, edges, strict=True)])
    summed = counted.groupby(["author_id", "code"], as_index=False)["n"].sum()
    held = summed.groupby("author_id").agg(codes=("code", list), counts=("n", list)).reset_index()
    bound = C._bound(k, WEIGHTS, STATIC, width)
    full = authors.merge(held, on="author_id")
    maybe = [bound(None, pd.concat([full, e]), p) for p, e in zip(cells, edges, strict=True)]
    return cells, edges, maybe


@pytest.mark.parametrize("ties", [False, True])
def test_bounds_hold_and_survivors_rank_exactly(ties):
    k = 5
    authors, papers, known = _fixture(20, 300, 8, ties)
    cells, edges, maybe = _bounded(authors, papers, known, k)
    found = pd.concat(maybe)
    left = found.drop(columns=["low", "high"]).assign(_kind=C.SURVIVOR)
    counts = pd.concat([C._exact(STATIC)(None, pd.concat([authors, e, left]), p) for p, e in zip(cells, edges, strict=True)])
    got = found.merge(counts.groupby(["author_id", "paper_id"], as_index=False).sum(), on=["author_id", "paper_id"])
    sims = np.round(np.stack(authors["embedding"]) @ np.stack(papers["embedding"]).T, C.PLACES)
    for a in range(20):
        mine = set(known.loc[known["author_id"] == a, "paper_id"])
        cand = papers[~papers["paper_id"].isin(mine)].assign(s=lambda d, a=a: sims[a, d["paper_id"]])
        score = WEIGHTS[0] * (cand.sort_values(["s", "paper_id"], ascending=[False, True]).assign(n=range(1, len(cand) + 1))["n"].sort_index())
        for w, c in zip(WEIGHTS[1:], STATIC, strict=True):
            score = score + w * cand[c].rank()
        one = got[got["author_id"] == a].set_index("paper_id")
        exact = WEIGHTS[0] * (one["ahead"] + 1) + sum(w * (one[c] - one[f"x_{c}"]) for w, c in zip(WEIGHTS[1:], STATIC, strict=True))
        assert np.allclose(exact, score[one.index])
        assert (one["low"] <= exact + 1e-9).all() and (exact <= one["high"] + 1e-9).all()
        assert set(score.nsmallest(k).index) <= set(one.index) and not mine & set(one.index)


def test_few_pairs_leave_a_cell():
    k = 10
    authors, papers, known = _fixture(100, 4000, 32, ties=False)
    for rows in _bounded(authors, papers, known, k)[2]:
        assert rows.groupby("author_id").size().max() <= 4 * k
