"""Author profiles: known-paper edges, profile vectors, lookups.

``interactions(author_id, kind, paper_id)`` is the long form of the profile map (kind -> set of
papers). Every operator here is a filter, join, distinct or grouped aggregate over it.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refrank.schemas import KIND_REFERENCE, KIND_WRITE, PROFILE_KINDS


def known_papers(interactions: DataFrame, author_id=None) -> DataFrame:
    """(author_id, paper_id) of every kind, NULL ids dropped, distinct (the exclusion set)."""
    edges = interactions.where(F.col("paper_id").isNotNull())
    if author_id is not None:
        edges = edges.where(F.col("author_id") == F.lit(author_id))
    return edges.select("author_id", "paper_id").distinct()


def profile_edges(interactions: DataFrame) -> DataFrame:
    """Distinct (author, paper) over write ∪ reference ∪ liked (never 'not liked')."""
    return (
        interactions.where(F.col("kind").isin(*PROFILE_KINDS) & F.col("paper_id").isNotNull())
        .select("author_id", "paper_id")
        .distinct()
    )


def author_vectors(interactions: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Mean embedding over each author's distinct known papers that have an embedding (a NULL
    vector counts as none).

    Summarizer is a partial-aggregating vector aggregate: a hot author is pre-reduced in every map
    task, so no task ever holds one author's papers as a group. Authors without any embedded paper
    are absent (see ``profile_coverage``).
    """
    return (
        profile_edges(interactions)
        .join(embeddings.select("paper_id", "embedding").where(F.col("embedding").isNotNull()), "paper_id")
        .groupBy("author_id")
        .agg(
            vector_to_array(Summarizer.mean(array_to_vector("embedding"))).alias("embedding"),
            F.count(F.lit(1)).alias("n_embedded"),
        )
    )


def profile_coverage(interactions: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Per author: distinct profile papers, how many have an embedding, how many are missing."""
    emb_ids = embeddings.where(F.col("embedding").isNotNull()).select("paper_id", F.lit(1).alias("_has"))
    return (
        profile_edges(interactions)
        .join(emb_ids, "paper_id", "left")
        .groupBy("author_id")
        .agg(
            F.count(F.lit(1)).alias("n_papers"),
            F.count("_has").alias("n_embedded"),
        )
        .withColumn("n_missing", F.col("n_papers") - F.col("n_embedded"))
    )


def missing_embeddings(interactions: DataFrame, embeddings: DataFrame) -> DataFrame:
    """(author_id, paper_id) of the distinct profile papers that have no embedding."""
    stored = embeddings.where(F.col("embedding").isNotNull()).select("paper_id")
    return profile_edges(interactions).join(stored, "paper_id", "left_anti").select("author_id", "paper_id")


def author_known_papers(interactions: DataFrame, author_id, authors: DataFrame | None = None) -> DataFrame:
    """The profile map of one author in long form: distinct (author_id, kind, paper_id), NULL ids
    dropped. A kind with millions of papers stays millions of rows; nothing is collected.
    With ``authors``, an unknown author raises ValueError (an existing author may know nothing)."""
    if authors is not None:
        require_author(authors, author_id)
    return (
        interactions.where((F.col("author_id") == F.lit(author_id)) & F.col("paper_id").isNotNull())
        .select("author_id", "kind", "paper_id")
        .distinct()
    )


def require_author(authors: DataFrame, author_id) -> DataFrame:
    """Author point lookup; raises ValueError when absent (one bounded take)."""
    row = authors.where(F.col("author_id") == F.lit(author_id)).limit(1)
    if not row.take(1):
        raise ValueError(f"author {author_id!r} does not exist")
    return authors.where(F.col("author_id") == F.lit(author_id))


def search_by_name(authors: DataFrame, text: str, literal: bool = False) -> DataFrame:
    """Case-insensitive substring search. Default: LIKE pattern (user % and _ act as wildcards,
    backslash escaped); ``literal=True`` matches the text as-is."""
    if literal:
        return authors.where(F.lower(F.col("name")).contains(text.lower()))
    pattern = "%" + text.replace("\\", "\\\\") + "%"
    return authors.where(F.col("name").ilike(pattern))


def profiles_from_papers(nested: DataFrame, order: tuple[str, ...] = ("paper_id",)) -> tuple[DataFrame, DataFrame]:
    """A2: derive profiles from nested papers.

    Every non-NULL author of a paper gets ``write`` = that paper and ``reference`` = every non-NULL
    id the paper cites. Returns ``(authors(author_id, name), interactions(author_id, kind,
    paper_id))``; the name is the first spelling in scan order (``order`` columns, then the author's
    position in the list), picked by a partial-aggregating ``min_by``.
    """
    written = nested.select(
        *order if "paper_id" in order else ("paper_id", *order),
        "references",
        F.posexplode("authors").alias("author_pos", "author"),
    ).where(F.col("author.authorId").isNotNull())
    author_id = F.col("author.authorId").alias("author_id")
    # One explode for both kinds: the paper itself, then what it cites.
    none = F.array().cast(written.select("references.paperId").schema["paperId"].dataType)
    known = F.concat(F.array("paper_id"), F.coalesce(F.col("references.paperId"), none))
    edges = (
        written.select(author_id, F.posexplode(known).alias("pos", "paper_id"))
        .where(F.col("paper_id").isNotNull())
        .select("author_id", F.when(F.col("pos") == 0, F.lit(KIND_WRITE)).otherwise(F.lit(KIND_REFERENCE)).alias("kind"), "paper_id")
        .distinct()
    )
    names = written.groupBy(author_id).agg(
        F.min_by(F.col("author.name"), F.struct(*[F.col(c) for c in order], F.col("author_pos"))).alias("name")
    )
    return names, edges
