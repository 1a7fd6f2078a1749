"""Profile mutations (D1-D8) as set operations that produce the next version of the tables.

Nothing is updated in place: each function returns new DataFrames (or the delta to append);
``refrank.sources.store.VersionedTable`` writes a new version and then moves the pointer, so a
reader never sees a half-written table and no job reads and overwrites the same path.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refrank.operators.papers import first_seen
from refrank.operators.profiles import require_author
from refrank.schemas import KIND_LIKED, KIND_WRITE

EDGE_COLUMNS = ("author_id", "kind", "paper_id")


def new_edges(existing: DataFrame, batch: DataFrame, trim: bool = True) -> DataFrame:
    """Distinct batch edges not yet stored — the delta to append (idempotent).

    ``trim=False`` is for a batch of most stored authors: the batch is then computed once, not a second time for
    its authors, and the store meets it by the three columns alone."""
    cols = list(EDGE_COLUMNS)
    fresh = batch.select(*cols).where(F.col("paper_id").isNotNull()).distinct()
    if not trim:
        return fresh.join(existing.select(*cols), cols, "left_anti")
    # Only the stored edges of the batch's authors can match: a semi-join on the batch's author
    # ids (the side AQE may broadcast) trims the store before the anti-join shuffles it.
    relevant = existing.select(*cols).join(fresh.select("author_id").distinct(), "author_id", "left_semi")
    return fresh.join(relevant, cols, "left_anti")


def new_authors(existing: DataFrame, batch: DataFrame, order: Sequence[str] = ("name",)) -> DataFrame:
    """D3 (authors): batch authors not yet stored, one row each (first in ``order`` wins).
    Stored names are never overwritten."""
    picked = first_seen(batch.select("author_id", "name", *[c for c in order if c != "name"]), "author_id", order)
    return picked.select("author_id", "name").join(existing.select("author_id"), "author_id", "left_anti")


def upsert_profiles(
    authors: DataFrame,
    interactions: DataFrame,
    batch_authors: DataFrame,
    batch_edges: DataFrame,
    order: Sequence[str] = ("name",),
    trim: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """D3: insert new authors, union their edges per kind; applying it twice equals once. ``trim`` as in ``new_edges``."""
    authors2 = authors.unionByName(new_authors(authors, batch_authors, order))
    interactions2 = interactions.select(*EDGE_COLUMNS).unionByName(new_edges(interactions, batch_edges, trim))
    return authors2, interactions2


def sign_up(
    authors: DataFrame, interactions: DataFrame, signups: DataFrame, seed_papers: Sequence
) -> tuple[DataFrame, DataFrame]:
    """Each (author_id, name) sign-up gets ``write`` = the seed papers and nothing else."""
    pid_type = interactions.schema["paper_id"].dataType
    seeds = F.array(*[F.lit(p).cast(pid_type) for p in seed_papers])
    edges = signups.select("author_id", F.lit(KIND_WRITE).alias("kind"), F.explode(seeds).alias("paper_id"))
    return upsert_profiles(authors, interactions, signups, edges)


def like_papers(
    authors: DataFrame, interactions: DataFrame, author_id, liked_ids: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Add the chosen paper ids to the author's ``liked`` set; ValueError for an unknown author."""
    require_author(authors, author_id)
    edges = liked_ids.select(
        F.lit(author_id).cast(interactions.schema["author_id"].dataType).alias("author_id"),
        F.lit(KIND_LIKED).alias("kind"),
        "paper_id",
    )
    return authors, interactions.select(*EDGE_COLUMNS).unionByName(new_edges(interactions, edges))


def clear_liked(interactions: DataFrame, author_id) -> DataFrame:
    """Liked := ∅ for one author; an unknown author is a silent no-op."""
    theirs = F.col("author_id").eqNullSafe(F.lit(author_id)) & F.col("kind").eqNullSafe(F.lit(KIND_LIKED))
    return interactions.where(~theirs)


def delete_profiles(authors: DataFrame, interactions: DataFrame, ids: DataFrame | Sequence) -> tuple[DataFrame, DataFrame]:
    """Drop whole profiles (author row and every edge); ids as a DataFrame or a short list."""
    if isinstance(ids, DataFrame):
        gone = ids.select("author_id")
        return (
            authors.join(gone, "author_id", "left_anti"),
            interactions.join(gone, "author_id", "left_anti"),
        )
    keep = ~F.col("author_id").isin(list(ids))
    return authors.where(keep), interactions.where(keep)


# Fixed value: least size of the id space new sign-ups draw from (ids "0".."9999").
ID_SPACE = 10000


def free_ids(authors: DataFrame, id_space: int = ID_SPACE) -> DataFrame:
    """Every id in the id space not held by an author."""
    ids = authors.sparkSession.range(id_space).select(
        F.col("id").cast(authors.schema["author_id"].dataType).alias("author_id")
    )
    return ids.join(authors.select("author_id"), "author_id", "left_anti")


def allocate_ids(authors: DataFrame, n: int, seed: int = 0, id_space: int = ID_SPACE) -> DataFrame:
    """N distinct unused ids at random, for n sign-ups at once (no retry loop).

    The id space grows when authors fill it: authors hold at most as many ids as there are of them, so a
    space of that size and n more has n free ones."""
    space = max(id_space, authors.count() + n)
    return free_ids(authors, space).orderBy(F.rand(seed), "author_id").limit(n)
