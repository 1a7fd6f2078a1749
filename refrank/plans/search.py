"""Keyword search — embed the keyword the same way as the corpus, rank every text by cosine.

The corpus side is an *index*: one sparse row per text with its norm, which the embedding job builds
once (``text_index``) and the caller stores; a search then only scans it (``search_index``). Nothing
is excluded from a search.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

from pyspark.sql import DataFrame

from refrank.functions.text import DEFAULT_DIM, TOKEN_SPLIT
from refrank.operators import embedding as E
from refrank.operators.embedding import HashEmbedder
from refrank.plans import recommend


def keyword_buckets(keyword: str, dim: int = DEFAULT_DIM) -> dict[int, int]:
    """Bucket -> token count of a keyword, as ``functions.text.token_bucket`` numbers them."""
    tokens = [t.lower() for t in re.split(TOKEN_SPLIT, keyword) if t]
    return dict(Counter(int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % dim for t in tokens))


def text_index(corpus: DataFrame, key: str, text: str, dim: int = DEFAULT_DIM) -> DataFrame:
    """Sparse corpus index: per id, token counts per bucket summed over the text's segments."""
    return E.sparse_rows(corpus, key, text, dim)


def search_index(index: DataFrame, key: str, keyword: str, k: int = 10, dim: int = DEFAULT_DIM) -> DataFrame:
    """Top-k ids of a sparse index by cosine to ``keyword`` (short text: one segment, no pooling)."""
    return E.sparse_cosine_top_k(index, keyword_buckets(keyword, dim), key, k)


def keyword_search(corpus: DataFrame, key: str, text: str, keyword: str, k: int = 10, dim: int = DEFAULT_DIM) -> DataFrame:
    """Build the index from ``corpus`` and search it (one-off use; store the index to reuse it)."""
    return search_index(text_index(corpus, key, text, dim), key, keyword, k, dim)


def search_papers(papers: DataFrame, embeddings: DataFrame, keyword: str, embedder=None, k: int = 10) -> DataFrame:
    """C1 over the stored paper embeddings: the keyword is embedded with the corpus's embedder
    (one short text, so one bounded vector) and every embedded paper is ranked by cosine."""
    spark = papers.sparkSession
    embedder = embedder or HashEmbedder()
    rows = embedder.embed(spark.createDataFrame([("q", keyword)], "k string, t string"), "k", "t").take(1)
    query = list(rows[0]["embedding"]) if rows else []
    if not query:
        raise ValueError("the keyword has no token to embed")
    return recommend.rank_by_similarity(papers, embeddings, query, None, k)
