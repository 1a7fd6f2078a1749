"""Incremental maintenance of embeddings and profile vectors.

R6 — embeddings are memoised by content: a paper is (re-)embedded only when the SHA-256 of its
text is not stored for it yet (S13), so a re-run costs nothing and an edited abstract is redone.
R7 — after a batch of new edges, profile vectors are recomputed only for the authors the batch
touches (left-semi on touched ids); every other author keeps the stored vector.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from refrank.operators.embedding import HashEmbedder, content_hash
from refrank.operators.papers import content_text
from refrank.operators.profiles import author_vectors


def embed_new_content(papers: DataFrame, stored: DataFrame, dim: int = 64, embedder=None) -> DataFrame:
    """(paper_id, content_sha, embedding) rows to add — only unseen (paper, content) pairs.
    ``stored`` has (paper_id, content_sha, embedding); ``embedder`` defaults to the hashed R8 one."""
    content = papers.select("paper_id", content_text().alias("content")).withColumn(
        "content_sha", content_hash("content")
    )
    todo = content.join(stored.select("paper_id", "content_sha"), ["paper_id", "content_sha"], "left_anti")
    embedder = embedder or HashEmbedder(dim)
    vecs = embedder.embed(todo.select("paper_id", "content"), "paper_id", "content")
    return todo.select("paper_id", "content_sha").join(vecs, "paper_id")


def latest_embeddings(stored: DataFrame, papers: DataFrame) -> DataFrame:
    """The live embedding of each paper: the row whose hash matches the paper's current content."""
    current = papers.select("paper_id", content_hash(content_text()).alias("content_sha"))
    return stored.join(current, ["paper_id", "content_sha"]).select("paper_id", "embedding")


def refresh_profiles(
    stored_vectors: DataFrame, interactions: DataFrame, batch_edges: DataFrame, embeddings: DataFrame
) -> DataFrame:
    """Vectors after ``batch_edges`` are merged into ``interactions`` (already containing them),
    recomputing only the touched authors."""
    touched = batch_edges.select("author_id").distinct()
    fresh = author_vectors(interactions.join(touched, "author_id", "left_semi"), embeddings).select(
        "author_id", "embedding"
    )
    kept = stored_vectors.select("author_id", "embedding").join(touched, "author_id", "left_anti")
    return kept.unionByName(fresh)
