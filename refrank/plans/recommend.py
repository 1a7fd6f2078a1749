"""User-level recommendation queries for one author or one keyword.

Plan shape, for every query here:
  papers ⋈ embeddings (J1)  →  anti-join known papers (J2, *before* scoring)  →  similarity (F1)
  →  ranks / top-k on narrow columns only  →  the k winners joined back to every paper column.
``operators.papers.display_projection`` turns nested authors and references of a result into names and ids.
The single query vector (D numbers) is the only value that passes through the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refrank.functions.vectors import DEFAULT_WEIGHTS, check_weights, cosine_to_constant, linear_score
from refrank.operators.profiles import author_vectors, known_papers
from refrank.operators.ranking import global_row_numbers, top_k
from refrank.session import cut_lineage
from refrank.schemas import RANK_FIELDS

DEFAULT_K = 10

# (rank column, ordering field) of the weighted model, in weight order.
WEIGHTED_RANKS = (
    ("cos_rank", "similarity"),
    ("ref_rank", "reference_count"),
    ("cite_rank", "citation_count"),
    ("inf_cite_rank", "influential_citation_count"),
    ("year_rank", "year"),
)


def author_query_vector(interactions: DataFrame, embeddings: DataFrame, author_id) -> list[float]:
    """A4 for one author: filter first (pushed into the scan), then the partial-aggregating mean."""
    mine = interactions.where(F.col("author_id") == F.lit(author_id))
    rows = author_vectors(mine, embeddings).select("embedding").take(1)
    if not rows:
        raise ValueError(f"author {author_id!r} has no paper with an embedding")
    return list(rows[0][0])


def scored_candidates(
    papers: DataFrame,
    embeddings: DataFrame,
    query: Sequence[float],
    exclude: DataFrame | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """(paper_id, similarity, *keep) for every embedded paper not in ``exclude``."""
    vectors = embeddings.select("paper_id", "embedding").where(F.col("embedding").isNotNull())
    cand = vectors.join(papers.select("paper_id", *keep), "paper_id")
    if exclude is not None:
        # Size is data-dependent (one author may know a third of the corpus): no forced broadcast;
        # AQE turns this into a broadcast join only when the runtime size is under its threshold.
        cand = cand.join(exclude.select("paper_id"), "paper_id", "left_anti")
    return cand.select("paper_id", *keep, cosine_to_constant("embedding", query).alias("similarity"))


def _hydrate(top: DataFrame, papers: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Join the k winners back to every column of ``papers`` (nested authors and references too).

    The limit tells the planner the size of that side, so it broadcasts a small k by itself. A paper
    column named like a score gives way to the score."""
    wide = papers.drop(*[c for c in top.columns if c != "paper_id"])
    return wide.join(top, "paper_id").orderBy(*order)


def rank_by_similarity(papers, embeddings, query, exclude=None, k: int = DEFAULT_K) -> DataFrame:
    """Top-k papers by cosine similarity, ties by paper_id."""
    order = [F.col("similarity").desc(), F.col("paper_id").asc()]
    top = top_k(scored_candidates(papers, embeddings, query, exclude), order, k)
    return _hydrate(top, papers, order)


def rank_weighted(
    papers, embeddings, query, exclude=None, weights: Sequence[float] = DEFAULT_WEIGHTS, k: int = DEFAULT_K
) -> DataFrame:
    """C3 core: five global row numbers over the candidates, fused score, ascending top-k."""
    check_weights(weights)
    # Candidates written once (they feed the stacked ranking and the join back), then all five
    # rankings numbered in one distributed pass.
    cand = cut_lineage(scored_candidates(papers, embeddings, query, exclude, keep=RANK_FIELDS))
    ranked = global_row_numbers(cand, "paper_id", [(r, field, True) for r, field in WEIGHTED_RANKS])
    ranked = ranked.select(
        "paper_id",
        "similarity",
        *[F.col(r).cast("bigint").alias(r) for r, _ in WEIGHTED_RANKS],
    ).withColumn("rank", linear_score([r for r, _ in WEIGHTED_RANKS], weights))
    order = [F.col("rank").asc(), F.col("paper_id").asc()]
    return _hydrate(top_k(ranked, order, k), papers, order)


def recommend_to_author(papers, embeddings, interactions, author_id, k: int = DEFAULT_K) -> DataFrame:
    """Profile vector, exclude every known paper, top-k by similarity."""
    q = author_query_vector(interactions, embeddings, author_id)
    exclude = known_papers(interactions, author_id)
    return rank_by_similarity(papers, embeddings, q, exclude, k)


def recommend_weighted(
    papers, embeddings, interactions, author_id, weights=DEFAULT_WEIGHTS, k: int = DEFAULT_K
) -> DataFrame:
    """Like C2, but ordered by the weighted sum of five candidate ranks (lower is better)."""
    q = author_query_vector(interactions, embeddings, author_id)
    exclude = known_papers(interactions, author_id)
    return rank_weighted(papers, embeddings, q, exclude, weights, k)


def recommend(
    papers, embeddings, interactions, author_id, mode: str = "cosine", weights=None, k: int = DEFAULT_K
) -> DataFrame:
    """One entry point, the ranking model chosen by ``mode`` ('cosine' or 'weighted')."""
    if mode == "cosine":
        return recommend_to_author(papers, embeddings, interactions, author_id, k)
    if mode == "weighted":
        return recommend_weighted(papers, embeddings, interactions, author_id, weights or DEFAULT_WEIGHTS, k)
    raise ValueError(f"unknown mode {mode!r}")


def order_by_field(papers: DataFrame, field: str, ascending: bool = False, k: int = DEFAULT_K) -> DataFrame:
    """Top-k papers by one numeric field (whitelisted); NULLs last under desc, first under asc."""
    if field not in RANK_FIELDS:
        raise ValueError(f"cannot order by {field!r}; allowed: {RANK_FIELDS}")
    key = F.col(field).asc() if ascending else F.col(field).desc()
    return top_k(papers, [key, F.col("paper_id").asc()], k)


# The four browse pages.
def latest(papers, k=DEFAULT_K):
    return order_by_field(papers, "year", k=k)


def most_referenced(papers, k=DEFAULT_K):
    return order_by_field(papers, "reference_count", k=k)


def most_cited(papers, k=DEFAULT_K):
    return order_by_field(papers, "citation_count", k=k)


def most_influential(papers, k=DEFAULT_K):
    return order_by_field(papers, "influential_citation_count", k=k)
