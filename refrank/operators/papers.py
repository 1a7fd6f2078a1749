"""Paper-table operators: first-wins dedup, insert-or-ignore, lookups, id-set and title selections,
display projection.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_seen(df: DataFrame, key: str | Sequence[str], order: Sequence[str]) -> DataFrame:
    """A1: one row per key, the one that comes first under ``order`` (e.g. file, position).

    Written as ``min_by(struct(row), struct(order))``: a partial aggregate, so a key that holds a
    third of all rows is pre-reduced in every map task instead of landing in one window partition.
    """
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(
        F.min_by(F.struct(*[F.col(c) for c in rest]), F.struct(*[F.col(c) for c in order])).alias("_first")
    )
    return picked.select(*keys, *[F.col("_first")[c].alias(c) for c in rest])


def insert_or_ignore(existing: DataFrame, incoming: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Rows already stored win; among new rows the first seen wins; result = stored ∪ new keys.

    Returns only the rows to append (write them with ``mode('append')``). A NULL key fails the job: it
    can neither be looked up nor matched when the batch comes again."""
    named = F.assert_true(F.col(key).isNotNull(), F.lit(f"NULL {key} in incoming rows"))
    fresh = first_seen(incoming.where(named.isNull()), key, order)
    # Stored keys that the batch touches (semi-join on the batch's keys), then the anti-join.
    taken = existing.select(key).join(fresh.select(key), key, "left_semi")
    return fresh.join(taken, key, "left_anti")


def require_paper(papers: DataFrame, paper_id) -> DataFrame:
    """Paper point lookup, typed equality; ValueError when absent (one bounded take)."""
    row = papers.where(F.col("paper_id") == F.lit(paper_id))
    if not row.limit(1).take(1):
        raise ValueError(f"paper {paper_id!r} does not exist")
    return row


def papers_by_ids(papers: DataFrame, ids: DataFrame | Sequence, id_col: str = "paper_id") -> DataFrame:
    """Papers whose id is in a set. A DataFrame set is a semi-join (no size assumption);
    a short literal list becomes ``isin``. Empty set -> empty result; unknown ids are dropped."""
    if isinstance(ids, DataFrame):
        return papers.join(ids.select(F.col(id_col).alias("paper_id")), "paper_id", "left_semi")
    ids = [i for i in ids if i is not None]
    if not ids:
        return papers.limit(0)
    return papers.where(F.col("paper_id").isin(ids))


def ids_by_title(candidates: DataFrame, titles: DataFrame | Sequence[str]) -> DataFrame:
    """Distinct paper ids whose title is among the chosen titles (duplicate titles all match)."""
    if not isinstance(titles, DataFrame):
        titles = candidates.sparkSession.createDataFrame([(t,) for t in titles], "title string")
    return candidates.join(titles.select("title").distinct(), "title", "left_semi").select("paper_id").distinct()


def display_projection(df: DataFrame) -> DataFrame:
    """P10: authors -> list of names, references -> list of ids; only when both columns exist."""
    if "authors" not in df.columns or "references" not in df.columns:
        return df
    return df.withColumn("authors", F.col("authors.name")).withColumn("references", F.col("references.paperId"))


def content_text(title: Column | str = "title", abstract: Column | str = "abstract") -> Column:
    """title || abstract with no separator; a NULL abstract gives the title alone."""
    t = F.col(title) if isinstance(title, str) else title
    a = F.col(abstract) if isinstance(abstract, str) else abstract
    return F.concat(t, F.coalesce(a, F.lit("")))


def page(papers: DataFrame, offset: int, n: int, key: str = "paper_id") -> DataFrame:
    """T4: one bounded page of the table in key order (``ORDER BY key LIMIT n OFFSET offset``).
    Optional: nothing in the library pages by default. One task merges offset + n rows: to walk through
    a large table use :func:`page_after`."""
    return papers.orderBy(key).offset(offset).limit(n)


def page_after(papers: DataFrame, last, n: int, key: str = "paper_id") -> DataFrame:
    """T4 by key: the ``n`` rows after key ``last`` (None: the first page). The bound reaches the scan,
    and no page costs more than ``n`` rows a task."""
    rest = papers if last is None else papers.where(F.col(key) > F.lit(last))
    return rest.orderBy(key).limit(n)
