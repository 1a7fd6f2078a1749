"""C3 for one author against a static-rank index: a per-call top-M scan instead of full sorts.

The four static ranks (references, citations, influential citations, year) do not depend on the
author, so they are computed once per data version over U (embedded papers) — ``static_rank_index``
— and stored or cached by the caller. A call then:

1. scores every candidate (one scan) and keeps the top-M by (similarity desc, id) with
   TakeOrderedAndProject — exact cos_rank 1..M;
2. corrects the static ranks of those M papers by the author's known papers ranked ahead: one
   stacked, skew-safe running count over (rank kind, static rank), whatever the author's size;
3. scores them and keeps the best k;
4. certifies: a paper outside the top-M has cos_rank >= M+1 and static part >=
   max(sum w, T_min - |K|*sum w) (non-negative weights). When that bound exceeds the k-th best
   score — or the top-M holds every candidate — the answer is exact; otherwise the call falls back
   to ranking every candidate (``recommend.rank_weighted``), which is exact by construction.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refrank.functions.vectors import DEFAULT_WEIGHTS, check_weights, linear_score
from refrank.operators.profiles import known_papers
from refrank.operators.ranking import global_row_number, running_count, top_k
from refrank.plans import recommend
from refrank.plans.batch import STATIC_RANKS, candidate_vectors, static_ranks
from refrank.session import cut_lineage

STATIC_COLS = [f"_R_{n}" for n, _ in STATIC_RANKS]


def static_rank_index(papers: DataFrame, embeddings: DataFrame) -> DataFrame:
    """(paper_id, _R_ref_rank, _R_cite_rank, _R_inf_cite_rank, _R_year_rank) over U, materialised."""
    cand = candidate_vectors(papers, embeddings).select("paper_id")
    ranked = static_ranks(papers.join(cand, "paper_id", "left_semi"))
    return cut_lineage(ranked.select("paper_id", *[F.col(n).alias(s) for (n, _), s in zip(STATIC_RANKS, STATIC_COLS)]))


def recommend_weighted_indexed(
    papers: DataFrame,
    embeddings: DataFrame,
    interactions: DataFrame,
    author_id,
    index: DataFrame,
    weights: Sequence[float] = DEFAULT_WEIGHTS,
    k: int = recommend.DEFAULT_K,
    depth: int | None = None,
) -> DataFrame:
    """Same result as ``recommend.recommend_weighted`` (C3), using a prebuilt static-rank index."""
    check_weights(weights)
    w = [float(x) for x in weights]
    rank_names = [n for n, _ in STATIC_RANKS]
    q = recommend.author_query_vector(interactions, embeddings, author_id)
    known = known_papers(interactions, author_id).select("paper_id")
    n_u = index.count()
    m = depth or max(10 * k, 100, math.ceil(4 * math.sqrt(k * n_u)))

    scored = recommend.scored_candidates(papers, embeddings, q, known)
    order = [F.col("similarity").desc(), F.col("paper_id").asc()]
    # m grows with the corpus (as its root), so its rows are numbered by ranges, not in one task
    numbered = global_row_number(top_k(scored, order, m), order, "cos_rank")
    top = cut_lineage(numbered.withColumn("cos_rank", F.col("cos_rank").cast("bigint")).join(index, "paper_id"))
    known_u = cut_lineage(known.join(index, "paper_id"))
    n_known = known_u.count()
    n_top = top.count()

    # x_i for every top paper: stacked over the four rank kinds, one running count.
    stacked = None
    for i, s in enumerate(STATIC_COLS):
        part = top.select("paper_id", F.lit(i).alias("_i"), F.col(s).alias("_v"), F.lit(False).alias("_known")).unionByName(
            known_u.select("paper_id", F.lit(i).alias("_i"), F.col(s).alias("_v"), F.lit(True).alias("_known"))
        )
        stacked = part if stacked is None else stacked.unionByName(part)
    ahead = (
        running_count(stacked, ["_i"], [F.col("_v").asc()], F.col("_known"), "_x")
        .where(~F.col("_known"))
        .groupBy("paper_id")
        .pivot("_i", list(range(len(STATIC_COLS))))
        .agg(F.first("_x"))
    )
    ranked = top.join(ahead, "paper_id").select(
        "paper_id",
        "similarity",
        "cos_rank",
        *[(F.col(s) - F.col(str(i))).alias(n) for i, (s, n) in enumerate(zip(STATIC_COLS, rank_names))],
    ).withColumn("rank", linear_score(["cos_rank", *rank_names], w))
    best = cut_lineage(top_k(ranked, [F.col("rank").asc(), F.col("paper_id").asc()], k))

    covered = n_top < m  # the top-M holds every candidate
    if not covered and min(w) >= 0:
        sum_static = sum(w[1:])
        t_min = index.agg(F.min(linear_score(STATIC_COLS, w[1:]))).first()[0]
        theta = best.agg(F.max("rank")).first()[0]
        bound = w[0] * (m + 1) + max(sum_static, t_min - n_known * sum_static)
        covered = theta is not None and bound > theta
    if not covered:
        return recommend.rank_weighted(papers, embeddings, q, known, weights, k)
    out = best.select(
        "paper_id", "similarity", *[F.col(r).cast("bigint").alias(r) for r, _ in recommend.WEIGHTED_RANKS], "rank"
    )
    return recommend._hydrate(out, papers, [F.col("rank").asc(), F.col("paper_id").asc()])
