"""Registered queries of the stored indexes: certified clusters, maintained ranks, invertible profile sums.

Importing this module adds them to ``refrank.plans.queries.QUERIES`` and ``ORACLE``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from refrank.functions.callback import register_callback
from refrank.operators import accumulators as ACC
from refrank.operators import allocation, bitmaps, names, ordered
from refrank.operators import mutations as M
from refrank.operators import profiles as PR
from refrank.operators.mutations import ID_SPACE
from refrank.operators.ranking import global_row_number
from refrank.plans import oracle as O
from refrank.plans import pruned, recommend
from refrank.plans import queries as Q
from refrank.plans.batch import STATIC_RANKS
from refrank.plans.queries import A, explode_vector, register, round_doubles
from refrank.plans.surface import ORACLE as ORACLE
from refrank.plans.surface import QUERIES as QUERIES
from refrank.plans.surface import CLEARED, DELETED, _landed
from refrank.schemas import KIND_LIKED
from refrank.session import cut_lineage
from refrank.sources import json_papers as J
from refrank.sources import pages
from refrank.sources.cache import ResultCache
from refrank.sources.store import scratch_path
from refrank.sources.testdata import TestTables
from refrank.streaming.stateful import run_stateful_likes


# ---------------------------------------------------------------- C2, R1 through certified clusters
@register("recommend_cosine_clustered", O.recommend_cosine_sql())
def q_recommend_cosine_clustered(spark, d):
    """The index of all embedded papers is built and stored, then one author's page comes from it."""
    t = TestTables(spark, d)
    index = pruned.build_paper_index(t.papers, t.paper_embeddings, scratch_path(spark, "clusters"))
    return round_doubles(pruned.recommend_to_author_clustered(t.papers, t.paper_embeddings, t.interactions, A, index)[0])


@register("batch_recommend_cosine_pruned", Q.ORACLE["batch_recommend_cosine"])
def q_batch_recommend_cosine_pruned(spark, d):
    t = TestTables(spark, d)
    out = pruned.batch_recommend_cosine_pruned(t.papers, t.paper_embeddings, t.interactions).result
    return round_doubles(out.withColumn("rn", F.col("rn").cast("bigint")))


# ---------------------------------------------------------------- R3, T2, T4: ranks kept up under inserts
LATE = 5  # every fifth paper arrives later, in two batches


@register("ranks_after_inserts", Q.ORACLE["global_ranks"])
def q_ranks_after_inserts(spark, d):
    papers = TestTables(spark, d).papers
    fields = []
    for name, field in STATIC_RANKS:
        rows = papers.select("paper_id", field)
        turn = F.col("paper_id") % (2 * LATE)
        store = ordered.build_ranks(rows.where(F.col("paper_id") % LATE != 0), scratch_path(spark, name), field, range_rows=1000)
        for late in (0, LATE):
            store = ordered.insert_ranks(store, rows.where(turn == late))
        fields.append(ordered.ranks(store).select("paper_id", F.col("rank").alias(name)))
    return reduce(lambda a, b: a.join(b, "paper_id"), fields)


DEEP = 150


@register(
    "citation_page_deep",
    O.with_(O.PAPERS)
    + f"""SELECT paper_id, citation_count, rank FROM (
  SELECT paper_id, citation_count, row_number() OVER (ORDER BY citation_count DESC NULLS LAST, paper_id) AS rank FROM papers)
WHERE rank > {DEEP} AND rank <= {DEEP} + 20""",
)
def q_citation_page_deep(spark, d):
    papers = TestTables(spark, d).papers
    store = ordered.build_ranks(papers, scratch_path(spark, "cited"), "citation_count", range_rows=100)
    return ordered.page(store, DEEP, 20)


# ---------------------------------------------------------------- A4, A6, R7, D5, D6 from the delta alone
@register("profile_sums_after_likes", Q.ORACLE["incremental_profile"])
def q_profile_sums_after_likes(spark, d):
    t = TestTables(spark, d)
    store = ACC.build_profiles(t.interactions, t.paper_embeddings, scratch_path(spark, "profiles"), buckets=16)
    store = ACC.like(store, t.like_events.select("author_id", "paper_id"), t.paper_embeddings)
    return round_doubles(explode_vector(ACC.profile_vectors(store), "author_id"))


@register(
    "profile_sums_after_clear",
    O.with_(O.EMB, O.INTER)
    + """SELECT author_id, CAST(i AS BIGINT) AS idx, round(avg(x), 6) + 0.0 AS value FROM (
  SELECT pp.author_id, unnest(range(len(e.embedding))) AS i, unnest(e.embedding) AS x
  FROM (SELECT DISTINCT author_id, paper_id FROM inter
        WHERE kind IN ('write', 'reference') OR kind = 'liked' AND author_id NOT IN (
          SELECT user_id FROM events WHERE event_type = 'purchase')) pp
  JOIN emb e ON e.paper_id = pp.paper_id) u
GROUP BY author_id, i""",
)
def q_profile_sums_after_clear(spark, d):
    """D6 for every author with a like event: their liked papers go, profiles follow from what went."""
    t = TestTables(spark, d)
    store = ACC.build_profiles(t.interactions, t.paper_embeddings, scratch_path(spark, "profiles"), buckets=16)
    store = ACC.clear(store, t.like_events.select("author_id"), t.paper_embeddings)
    return round_doubles(explode_vector(ACC.profile_vectors(store), "author_id"))


# ---------------------------------------------------------------- R4, D5: keyed state in the stream
@register(
    "stream_likes_stateful",
    O.with_(O.INTER, Q.LIKES_SQL) + "SELECT author_id, kind, paper_id FROM likes EXCEPT SELECT author_id, kind, paper_id FROM inter",
)
def q_stream_likes_stateful(spark, d):
    """What the events add to the stored edges, which the stream reads once, as its initial state."""
    sink = scratch_path(spark, "new-likes")
    stored = TestTables(spark, d).interactions
    run_stateful_likes(spark, f"{d.rstrip('/')}/events*.parquet", stored, sink, scratch_path(spark, "like-state"))
    return spark.read.schema(Q.EDGES_LONG).parquet(sink)


@register("stream_likes_stateful_out_of_order", Q.ORACLE["stream_likes"])
def q_stream_likes_stateful_out_of_order(spark, d):
    """Several micro-batches whose files arrive newest first, on an empty store: every late like is kept."""
    landing, sink = scratch_path(spark, "late-events"), scratch_path(spark, "late-likes")
    events = TestTables(spark, d).raw("events")
    events.repartitionByRange(3, F.col("ts").desc()).sortWithinPartitions(F.col("ts").desc()).write.parquet(landing)
    none = spark.createDataFrame([], Q.EDGES_LONG)
    run_stateful_likes(spark, landing, none, sink, scratch_path(spark, "late-state"), max_files=1)
    return spark.read.schema(Q.EDGES_LONG).parquet(sink).where(F.col("kind") == KIND_LIKED)


# ---------------------------------------------------------------- P5, C6: trigram postings
PATTERNS = {"#0000007": False, "tomer#00000_2%9": False, "MER#000000_1": True, "%7": False}


@register(
    "author_name_search_indexed",
    O.with_(O.AUTHORS)
    + " UNION ALL ".join(
        f"SELECT '{p}' AS pattern, author_id, name FROM authors WHERE "
        + (f"contains(lower(name), lower('{p}'))" if literal else f"name ILIKE '%{p}%'")
        for p, literal in PATTERNS.items()
    ),
)
def q_author_name_search_indexed(spark, d):
    """Literals, wildcards, a literal with a wildcard character, and a pattern too short for a trigram."""
    index = names.build_name_index(TestTables(spark, d).authors, scratch_path(spark, "names"))
    found = [names.search_names(index, p, literal).select(F.lit(p).alias("pattern"), "author_id", "name") for p, literal in PATTERNS.items()]
    return reduce(lambda a, b: a.unionAll(b), found)


# ---------------------------------------------------------------- D8, D4: unused ids, spread
@register(
    "allocated_ids_spread",
    f"""WITH n AS (SELECT count(DISTINCT user_id) AS n FROM events),
space AS (SELECT greatest({ID_SPACE}, (SELECT count(*) FROM customer) + n) AS space, n FROM n),
held AS (SELECT count(DISTINCT c_custkey) AS held FROM customer, space WHERE c_custkey >= 0 AND c_custkey < space)
SELECT n AS n_ids, n AS n_distinct, CAST(0 AS BIGINT) AS n_taken, CAST(0 AS BIGINT) AS n_outside,
       CAST(space - held AS BIGINT) AS free_before, CAST(space - held - n AS BIGINT) AS free_after FROM space, held""",
)
def q_allocated_ids_spread(spark, d):
    """D8 for as many sign-ups as the events have users: distinct, unused, and what is free before and after."""
    t = TestTables(spark, d)
    signups = t.raw("events").select("user_id").distinct()
    given = allocation.sign_up_ids(signups, t.authors, ["user_id"])
    space = F.greatest(F.lit(ID_SPACE).cast("bigint"), F.lit(t.authors.count()) + F.lit(signups.count()))
    held = t.authors.select("author_id", F.lit(1).alias("taken"))
    inside = (F.col("author_id") >= 0) & (F.col("author_id") < space)
    free = space - F.lit(t.authors.where(inside).select("author_id").distinct().count())
    return given.join(held, "author_id", "left").agg(
        F.count("author_id").alias("n_ids"),
        F.countDistinct("author_id").alias("n_distinct"),
        F.count("taken").alias("n_taken"),
        F.count_if(~inside).alias("n_outside"),
        free.alias("free_before"),
        (free - F.countDistinct("author_id")).alias("free_after"),
    )


# ---------------------------------------------------------------- S1, S3, R5: landed pages as a data source
PAGE_ROWS = 100
PAGE_QUERY = "Machine Learning"


def _land(spark, d) -> str:
    """The papers in id order, landed as named pages."""
    path = scratch_path(spark, "landed")
    numbered = global_row_number(TestTables(spark, d).nested_papers, ["paper_id"], "n")
    pages.land_pages(_landed(numbered, (F.col("n") - 1).alias("n")), path, PAGE_QUERY, "n", PAGE_ROWS)
    return path


@register("json_pages_source", Q.ORACLE["json_roundtrip_papers"])
def q_json_pages_source(spark, d):
    back = J.to_store_columns(pages.read_pages(spark, _land(spark, d)))
    ids = lambda c: F.nullif(F.array_join(F.col(c), ","), F.lit(""))
    return back.select(
        F.col("paper_id").cast("bigint").alias("paper_id"),
        *[c for c in O.PAPER_COLS.split(", ") if c != "paper_id"],
        F.size("authors").alias("n_authors"),
        ids("authors.authorId").alias("author_ids"),
        ids("references.paperId").alias("reference_ids"),
    )


@register(
    "page_names",
    O.with_(O.PAPERS)
    + f"""SELECT '{PAGE_QUERY}' AS query, CAST(n // {PAGE_ROWS} * {PAGE_ROWS} AS BIGINT) AS offset_from,
  CAST(n // {PAGE_ROWS} * {PAGE_ROWS} + {PAGE_ROWS} AS BIGINT) AS offset_to, CAST(n % {PAGE_ROWS} AS BIGINT) AS pos, paper_id
FROM (SELECT paper_id, row_number() OVER (ORDER BY paper_id) - 1 AS n FROM papers)""",
)
def q_page_names(spark, d):
    """S3: query and offsets of the page each paper came with, as values of their types."""
    back = pages.read_pages(spark, _land(spark, d))
    return back.select("query", "offset_from", "offset_to", "pos", F.col("paperId").cast("bigint").alias("paper_id"))


@register("stream_pages", O.with_(O.PAPERS) + f"SELECT {O.PAPER_COLS} FROM papers")
def q_stream_pages(spark, d):
    """The same reader as a stream into a Parquet sink."""
    sink = scratch_path(spark, "streamed")
    cols = O.PAPER_COLS.split(", ")
    rows = J.to_store_columns(pages.stream_pages(spark, _land(spark, d))).select(*cols)
    q = rows.writeStream.format("parquet").option("path", sink).option("checkpointLocation", scratch_path(spark, "pages-state"))
    q.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(sink).withColumn("paper_id", F.col("paper_id").cast("bigint"))


# ---------------------------------------------------------------- J2, A7, D1: exclusion sets as bitmaps
@register(
    "known_papers_bitmaps",
    O.with_(O.PAPERS, O.INTER)
    + "SELECT author_id, count(DISTINCT paper_id)::BIGINT AS n_papers FROM inter WHERE paper_id IN (SELECT paper_id FROM papers) GROUP BY author_id",
)
def q_known_papers_bitmaps(spark, d):
    """A7 for all authors: one bitmap per kind, united over the kinds, counted."""
    t = TestTables(spark, d)
    kinds = bitmaps.paper_bitmaps(t.interactions, bitmaps.number_papers(t.papers), ("author_id", "kind"))
    return bitmaps.sizes(bitmaps.united(kinds))


@register(
    "new_likes_bitmaps",
    O.with_(O.PAPERS, O.INTER, Q.LIKES_SQL)
    + """SELECT author_id, paper_id FROM likes WHERE NOT EXISTS (
  SELECT 1 FROM inter i JOIN papers p ON p.paper_id = i.paper_id WHERE i.author_id = likes.author_id AND i.paper_id = likes.paper_id)""",
)
def q_new_likes_bitmaps(spark, d):
    """The likes of papers that their authors do not know, by a bit instead of an anti-join on edges."""
    t = TestTables(spark, d)
    numbers = cut_lineage(bitmaps.number_papers(t.papers))
    likes = t.like_events.select("author_id", "paper_id").distinct()
    return bitmaps.not_known(likes, bitmaps.paper_bitmaps(t.interactions, numbers), numbers)


# ---------------------------------------------------------------- S8, U3: row callbacks from SQL
def _cited_so_far(row, state):
    state["n"] = state.get("n", 0) + 1
    state["cited"] = state.get("cited", 0) + row["citation_count"]
    yield row["paper_id"], row["year"], state["n"], state["cited"]


@register(
    "row_callback",
    O.with_(O.PAPERS)
    + """SELECT paper_id, year, row_number() OVER w AS nth, CAST(sum(citation_count) OVER w AS BIGINT) AS cited
FROM papers WINDOW w AS (PARTITION BY year ORDER BY paper_id)""",
)
def q_row_callback(spark, d):
    """A callback over every paper, year by year in id order, called from SQL."""
    TestTables(spark, d).papers.createOrReplaceTempView("callback_papers")
    register_callback(spark, "cited_so_far", _cited_so_far, "paper_id long, year int, nth long, cited long")
    return spark.sql("SELECT * FROM cited_so_far(TABLE(SELECT paper_id, year, citation_count FROM callback_papers) PARTITION BY year ORDER BY paper_id)")


# ---------------------------------------------------------------- D3, D5, D6, D7 as deltas; S12
@register("profile_store_life_cycle", ORACLE["profile_life_cycle"])
def q_profile_store_life_cycle(spark, d):
    """Update, like, clear, delete on the stored edges and sums: every step rewrites the buckets it touches."""
    t = TestTables(spark, d)
    new_authors, batch = PR.profiles_from_papers(t.nested_papers)
    authors = t.authors.unionByName(M.new_authors(t.authors, new_authors))
    store = ACC.build_profiles(t.interactions, t.paper_embeddings, scratch_path(spark, "life"), buckets=16)
    store = ACC.apply_changes(store, batch.withColumn("present", F.lit(True)), t.paper_embeddings)
    liked = recommend.most_cited(t.papers).select(F.lit(A).cast("bigint").alias("author_id"), "paper_id")
    store = ACC.like(store, liked, t.paper_embeddings)
    ids = lambda i: spark.createDataFrame([(i,)], "author_id long")
    store = ACC.clear(store, ids(CLEARED), t.paper_embeddings)
    store = ACC.delete(store, ids(DELETED), t.paper_embeddings)
    left = authors.where(F.col("author_id") != DELETED)
    return left.join(ACC.edges_long(store), "author_id", "left").select("author_id", "name", "kind", "paper_id")


@register("cached_recommendation", O.recommend_cosine_sql())
def q_cached_recommendation(spark, d):
    """Computed and stored on the first call, read on the second."""
    t = TestTables(spark, d)
    cache = ResultCache(spark, scratch_path(spark, "cache"))
    key = {"author": A, "mode": "cosine", "tables": d}

    def compute():
        return recommend.recommend_to_author(t.papers, t.paper_embeddings, t.interactions, A)

    def never():
        raise AssertionError("the stored result was not read")

    cache.get_or_compute(compute, **key)
    return round_doubles(cache.get_or_compute(never, **key))
