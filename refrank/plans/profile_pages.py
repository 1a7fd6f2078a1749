"""Author-facing composite queries: the author page (C5) and find-then-recommend."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refrank.operators.profiles import require_author, search_by_name
from refrank.plans import recommend


def author_page(authors: DataFrame, interactions: DataFrame, papers: DataFrame, author_id) -> DataFrame:
    """The author row (error when absent) and its known papers hydrated per kind (J5), with every
    column of ``papers``. An author without known papers is one row with NULL paper columns."""
    me = require_author(authors, author_id).select("author_id", "name")
    mine = interactions.where(F.col("author_id") == F.lit(author_id)).select("author_id", "kind", "paper_id")
    known = mine.join(papers.drop("author_id", "name", "kind"), "paper_id")
    rest = [c for c in known.columns if c not in ("author_id", "kind")]
    return me.join(known, "author_id", "left").select("author_id", "name", "kind", *rest)


def find_and_recommend(
    authors, papers, embeddings, interactions, name_text: str, mode: str = "cosine", weights=None, k: int = 10
) -> DataFrame:
    """Name search, then recommend for the (single) matching author; U5 chooses the model."""
    found = search_by_name(authors, name_text).select("author_id").limit(2).collect()
    if len(found) != 1:
        raise ValueError(f"{len(found)} authors match {name_text!r}; pick one id")
    author_id = found[0][0]
    return recommend.recommend(papers, embeddings, interactions, author_id, mode, weights, k)
