"""Registered queries: name -> (spark, sf_dir) -> DataFrame, each over the whole test tables, and
the DuckDB oracle SQL for each (``refrank.plans.oracle`` holds the shared CTEs)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from refrank.operators import papers as P
from refrank.operators import profiles as PR
from refrank.plans import oracle as O
from refrank.plans import recommend
from refrank.sources.testdata import TestTables

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


def round_doubles(df: DataFrame, places: int = 6) -> DataFrame:
    """Round every double column so the oracle comparison is not at the mercy of summation order."""
    return df.select(
        *[
            (F.round(F.col(f.name), places) + F.lit(0.0)).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def explode_vector(df: DataFrame, key: str, vec: str = "embedding") -> DataFrame:
    """(key, idx, value) rows: one per vector component, so values compare as scalars."""
    return df.select(key, F.posexplode(vec).alias("idx", "value")).withColumn("idx", F.col("idx").cast("bigint"))


A = O.FLAGSHIP_AUTHOR


def _pei(spark, d):
    """(papers, paper_embeddings, interactions) of one scale-factor folder."""
    t = TestTables(spark, d)
    return t.papers, t.paper_embeddings, t.interactions

# ---------------------------------------------------------------- C2, C3, T2
register("recommend_weighted", O.recommend_weighted_sql())(
    lambda spark, d: round_doubles(
        recommend.recommend_weighted(*_pei(spark, d), A)
    )
)
register("recommend_cosine", O.recommend_cosine_sql())(
    lambda spark, d: round_doubles(recommend.recommend_to_author(*_pei(spark, d), A))
)


def _field_query(name: str, field: str, ascending: bool = False) -> None:
    register(name, O.order_by_field_sql(field, ascending))(
        lambda spark, d: recommend.order_by_field(TestTables(spark, d).papers, field, ascending)
    )


_field_query("top_latest", "year")
_field_query("top_referenced", "reference_count")
_field_query("top_cited", "citation_count")
_field_query("top_influential", "influential_citation_count")
_field_query("order_by_ascending", "citation_count", ascending=True)

# ---------------------------------------------------------------- A4, A6, J4


@register(
    "author_profile_vector",
    O.with_(O.EMB, O.INTER)
    + """SELECT author_id, CAST(i AS BIGINT) AS idx, round(avg(x), 6) + 0.0 AS value FROM (
  SELECT pp.author_id, unnest(range(len(e.embedding))) AS i, unnest(e.embedding) AS x
  FROM (SELECT DISTINCT author_id, paper_id FROM inter WHERE kind IN ('write', 'reference', 'liked')) pp
  JOIN emb e ON e.paper_id = pp.paper_id) u
GROUP BY author_id, i""",
)
def q_author_profile_vector(spark, d):
    t = TestTables(spark, d)
    return round_doubles(explode_vector(PR.author_vectors(t.interactions, t.paper_embeddings), "author_id"))


@register(
    "author_profile_coverage",
    O.with_(O.EMB, O.INTER)
    + """SELECT pp.author_id, count(*) AS n_papers, count(e.paper_id) AS n_embedded,
       count(*) - count(e.paper_id) AS n_missing
FROM (SELECT DISTINCT author_id, paper_id FROM inter WHERE kind IN ('write', 'reference', 'liked')) pp
LEFT JOIN emb e ON e.paper_id = pp.paper_id GROUP BY pp.author_id""",
)
def q_author_profile_coverage(spark, d):
    t = TestTables(spark, d)
    return PR.profile_coverage(t.interactions, t.paper_embeddings)


# ---------------------------------------------------------------- P9, C5, P5, P3, P2, P4


@register(
    "author_known_papers",
    O.with_(O.INTER) + f"SELECT DISTINCT author_id, kind, paper_id FROM inter WHERE author_id = {A}",
)
def q_author_known_papers(spark, d):
    t = TestTables(spark, d)
    return PR.author_known_papers(t.interactions, A, t.authors)


@register(
    "author_page",
    O.with_(O.PAPERS, O.AUTHORS, O.INTER)
    + f"""SELECT a.author_id, a.name, i.kind, p.*
FROM authors a JOIN inter i ON i.author_id = a.author_id JOIN papers p ON p.paper_id = i.paper_id
WHERE a.author_id = {A}""",
)
def q_author_page(spark, d):
    t = TestTables(spark, d)
    from refrank.plans.profile_pages import author_page

    return author_page(t.authors, t.interactions, t.papers, A)


NAME_QUERY = "customer#00000012"


@register(
    "author_name_search",
    O.with_(O.AUTHORS) + f"SELECT author_id, name FROM authors WHERE name ILIKE '%{NAME_QUERY}%'",
)
def q_author_name_search(spark, d):
    return PR.search_by_name(TestTables(spark, d).authors, NAME_QUERY)


@register("author_lookup", O.with_(O.AUTHORS) + f"SELECT author_id, name FROM authors WHERE author_id = {A}")
def q_author_lookup(spark, d):
    return PR.require_author(TestTables(spark, d).authors, A)


@register("paper_lookup", O.with_(O.PAPERS) + f"SELECT {O.PAPER_COLS} FROM papers WHERE paper_id = {A}")
def q_paper_lookup(spark, d):
    return P.require_paper(TestTables(spark, d).papers, A)


@register(
    "papers_by_id_set",
    O.with_(O.PAPERS, O.EMB) + f"SELECT {O.PAPER_COLS} FROM papers WHERE paper_id IN (SELECT paper_id FROM emb)",
)
def q_papers_by_id_set(spark, d):
    t = TestTables(spark, d)
    return P.papers_by_ids(t.papers, t.paper_embeddings.select("paper_id"))


# ---------------------------------------------------------------- A1, S5, A2, P10

SPLIT_DATE = "1997-01-01"


@register(
    "ingest_dedup_first_wins",
    O.with_(O.RAW)
    + """SELECT paper_id, arg_min(pos, pos) AS pos, arg_min(title, pos) AS title FROM raw GROUP BY paper_id""",
)
def q_ingest_dedup_first_wins(spark, d):
    raw = TestTables(spark, d).raw_papers
    return P.first_seen(raw, "paper_id", ["file", "pos"]).select("paper_id", "pos", "title")


@register(
    "insert_or_ignore",
    O.with_(O.RAW)
    + f""", old AS (SELECT paper_id, arg_min(pos, pos) AS pos, arg_min(title, pos) AS title FROM raw
            WHERE o_orderdate < TIMESTAMP '{SPLIT_DATE}' GROUP BY paper_id),
new AS (SELECT paper_id, arg_min(pos, pos) AS pos, arg_min(title, pos) AS title FROM raw
        WHERE o_orderdate >= TIMESTAMP '{SPLIT_DATE}' GROUP BY paper_id)
SELECT * FROM old UNION ALL SELECT * FROM new WHERE paper_id NOT IN (SELECT paper_id FROM old)""",
)
def q_insert_or_ignore(spark, d):
    t = TestTables(spark, d)
    orders = t.raw("orders").select("o_orderkey", "o_orderdate")
    raw = t.raw_papers.join(orders, F.col("pos") == F.col("o_orderkey")).drop("o_orderkey")
    cut = F.lit(SPLIT_DATE).cast("timestamp")
    old = P.first_seen(raw.where(F.col("o_orderdate") < cut).drop("o_orderdate"), "paper_id", ["file", "pos"])
    new = raw.where(F.col("o_orderdate") >= cut).drop("o_orderdate")
    appended = P.insert_or_ignore(old, new, "paper_id", ["file", "pos"])
    return old.unionByName(appended).select("paper_id", "pos", "title")


@register(
    "profiles_from_papers",
    O.with_(O.PAPERS, O.INTER, O.NESTED)
    + """, a AS (
  SELECT paper_id, "references", unnest(authors) AS au, generate_subscripts(authors, 1) AS author_pos FROM nested),
edges AS (
  SELECT DISTINCT au.authorId AS author_id, 'write' AS kind, paper_id FROM a WHERE au.authorId IS NOT NULL
  UNION
  SELECT DISTINCT author_id, 'reference', ref FROM (
    SELECT au.authorId AS author_id, unnest("references").paperId AS ref FROM a WHERE au.authorId IS NOT NULL) r
  WHERE ref IS NOT NULL),
names AS (SELECT au.authorId AS author_id, arg_min(au.name, paper_id * 100000 + author_pos) AS name
          FROM a WHERE au.authorId IS NOT NULL GROUP BY au.authorId)
SELECT e.author_id, n.name, e.kind, e.paper_id FROM edges e JOIN names n ON e.author_id = n.author_id""",
)
def q_profiles_from_papers(spark, d):
    names, edges = PR.profiles_from_papers(TestTables(spark, d).nested_papers)
    return edges.join(names, "author_id").select("author_id", "name", "kind", "paper_id")


@register(
    "display_projection",
    O.with_(O.PAPERS, O.INTER, O.NESTED)
    + """SELECT paper_id, title, array_to_string(list_transform(authors, lambda x: x.name), ', ') AS author_names,
       array_to_string(list_transform("references", lambda x: CAST(x.paperId AS VARCHAR)), ',') AS reference_ids
FROM nested""",
)
def q_display_projection(spark, d):
    shown = P.display_projection(TestTables(spark, d).nested_papers)
    return shown.select(
        "paper_id",
        "title",
        F.array_join("authors", ", ").alias("author_names"),
        F.array_join(F.transform("references", lambda x: x.cast("string")), ",").alias("reference_ids"),
    )


# ---------------------------------------------------------------- F4, F5, R8, A5, C1
from refrank.functions.text import DEFAULT_DIM, SEGMENT_STEP, SEGMENT_WIDTH  # noqa: E402
from refrank.operators import embedding as E  # noqa: E402

SEG_SQL = f"""seg AS (
  SELECT doc_id, CAST(start // {SEGMENT_STEP} AS BIGINT) AS seg_idx,
         substring(text, start + 1, {SEGMENT_WIDTH}) AS segment
  FROM (SELECT doc_id, text, unnest(range(0, length(text), {SEGMENT_STEP})) AS start FROM documents))"""


def tok_bucket_sql(text_expr: str, keys: str, src: str) -> str:
    """(keys, bucket) per token of ``text_expr`` in ``src``."""
    return f"""SELECT {keys}, CAST(CAST('0x' || substr(md5(tok), 1, 8) AS BIGINT) % {DEFAULT_DIM} AS INTEGER) AS bucket
  FROM (SELECT {keys}, lower(unnest(string_split_regex({text_expr}, '[^A-Za-z0-9]+'))) AS tok FROM {src})
  WHERE length(tok) > 0"""


@register(
    "text_concat_null_abstract",
    O.with_(O.PAPERS) + "SELECT paper_id, title || COALESCE(abstract, '') AS content FROM papers",
)
def q_text_concat(spark, d):
    return TestTables(spark, d).papers.select("paper_id", P.content_text().alias("content"))


@register(
    "text_segments",
    O.with_(SEG_SQL)
    + "SELECT doc_id, seg_idx, CAST(length(segment) AS INTEGER) AS seg_len, md5(segment) AS seg_md5 FROM seg",
)
def q_text_segments(spark, d):
    seg = E.text_segments(TestTables(spark, d).documents, "doc_id")
    return seg.select(
        "doc_id",
        F.col("seg_idx").cast("bigint").alias("seg_idx"),
        F.length("segment").alias("seg_len"),
        F.md5("segment").alias("seg_md5"),
    )


@register(
    "hash_embedding",
    f"SELECT doc_id, bucket, count(*) AS cnt FROM ({tok_bucket_sql('text', 'doc_id', 'documents')}) GROUP BY doc_id, bucket",
)
def q_hash_embedding(spark, d):
    return E.bucket_counts(TestTables(spark, d).documents, ["doc_id"], "text")


@register(
    "segment_pooling",
    O.with_(SEG_SQL)
    + f"""SELECT doc_id, bucket, count(*) / {float(DEFAULT_DIM)} AS value
FROM ({tok_bucket_sql('segment', 'doc_id, seg_idx', 'seg')}) GROUP BY doc_id, bucket""",
)
def q_segment_pooling(spark, d):
    return round_doubles(E.pooled_long(TestTables(spark, d).documents, "doc_id"))


KEYWORD = "the energy of ouen ertion"


@register(
    "keyword_search",
    O.with_(SEG_SQL)
    + f""", dc AS (SELECT doc_id, bucket, count(*) AS cnt
       FROM ({tok_bucket_sql('segment', 'doc_id, seg_idx', 'seg')}) GROUP BY doc_id, bucket),
qc AS (SELECT bucket, count(*) AS cnt FROM ({tok_bucket_sql('q', 'q', "(SELECT '" + KEYWORD + "' AS q)")}) GROUP BY bucket),
qq AS (SELECT sum(cnt * cnt) AS qq FROM qc),
nd AS (SELECT doc_id, sum(cnt * cnt) AS dd FROM dc GROUP BY doc_id),
dt AS (SELECT dc.doc_id, sum(dc.cnt * qc.cnt) AS dot FROM dc JOIN qc ON dc.bucket = qc.bucket GROUP BY dc.doc_id),
sc AS (SELECT nd.doc_id, CASE WHEN nd.dd = 0 OR qq.qq = 0 THEN 0.0
                  ELSE COALESCE(dt.dot, 0) / (sqrt(nd.dd) * sqrt(qq.qq)) END AS similarity
       FROM nd CROSS JOIN qq LEFT JOIN dt ON nd.doc_id = dt.doc_id)
SELECT doc_id, round(similarity, 6) + 0.0 AS similarity FROM sc ORDER BY similarity DESC, doc_id LIMIT 10""",
)
def q_keyword_search(spark, d):
    from refrank.plans.search import keyword_search

    return round_doubles(keyword_search(TestTables(spark, d).documents, "doc_id", "text", KEYWORD))


# ---------------------------------------------------------------- D3-D8
from refrank.operators import mutations as M  # noqa: E402

SEED_PAPER = 0
SIGNUP_ID_BASE = 1_000_000


def _edge_counts(authors: DataFrame, interactions: DataFrame) -> DataFrame:
    return authors.join(
        interactions.groupBy("author_id").agg(F.count(F.lit(1)).alias("n_edges")), "author_id", "left"
    ).select("author_id", "name", F.coalesce("n_edges", F.lit(0)).alias("n_edges"))


@register(
    "profile_upsert",
    O.with_(O.PAPERS, O.AUTHORS, O.INTER, O.NESTED)
    + """, a AS (SELECT paper_id, "references", unnest(authors) AS au, generate_subscripts(authors, 1) AS author_pos
           FROM nested),
bedges AS (
  SELECT DISTINCT au.authorId AS author_id, 'write' AS kind, paper_id FROM a WHERE au.authorId IS NOT NULL
  UNION
  SELECT DISTINCT author_id, 'reference', ref FROM (
    SELECT au.authorId AS author_id, unnest("references").paperId AS ref FROM a WHERE au.authorId IS NOT NULL) r
  WHERE ref IS NOT NULL),
bnames AS (SELECT au.authorId AS author_id, arg_min(au.name, paper_id * 100000 + author_pos) AS name
           FROM a WHERE au.authorId IS NOT NULL GROUP BY au.authorId),
all_authors AS (SELECT author_id, name FROM authors
                UNION ALL SELECT author_id, name FROM bnames WHERE author_id NOT IN (SELECT author_id FROM authors)),
all_edges AS (SELECT author_id, kind, paper_id FROM inter UNION SELECT author_id, kind, paper_id FROM bedges)
SELECT x.author_id, x.name, e.kind, count(*) AS n_papers
FROM all_authors x JOIN all_edges e ON x.author_id = e.author_id GROUP BY x.author_id, x.name, e.kind""",
)
def q_profile_upsert(spark, d):
    t = TestTables(spark, d)
    names, edges = PR.profiles_from_papers(t.nested_papers)
    authors2, inter2 = M.upsert_profiles(t.authors, t.interactions, names, edges, trim=False)
    return (
        authors2.join(inter2, "author_id")
        .groupBy("author_id", "name", "kind")
        .agg(F.count(F.lit(1)).alias("n_papers"))
    )


@register(
    "sign_up_seed",
    O.with_(O.AUTHORS, O.INTER)
    + f""", su AS (SELECT {SIGNUP_ID_BASE} + event_id AS author_id, 'user' || user_id || '@' || event_id AS name
        FROM events WHERE event_type = 'signup'),
x AS (SELECT * FROM authors UNION ALL SELECT * FROM su WHERE author_id NOT IN (SELECT author_id FROM authors)),
e AS (SELECT author_id, kind, paper_id FROM inter
      UNION SELECT author_id, 'write', {SEED_PAPER} FROM su)
SELECT x.author_id, x.name, count(e.author_id) AS n_edges FROM x LEFT JOIN e ON x.author_id = e.author_id
GROUP BY x.author_id, x.name""",
)
def q_sign_up_seed(spark, d):
    t = TestTables(spark, d)
    signups = t.raw("events").where(F.col("event_type") == "signup").select(
        (F.lit(SIGNUP_ID_BASE) + F.col("event_id")).alias("author_id"),
        F.concat(F.lit("user"), F.col("user_id").cast("string"), F.lit("@"), F.col("event_id").cast("string")).alias(
            "name"
        ),
    )
    authors2, inter2 = M.sign_up(t.authors, t.interactions, signups, [SEED_PAPER])
    return _edge_counts(authors2, inter2)


@register(
    "like_by_title",
    O.with_(O.PAPERS, O.EMB, O.INTER, O.author_vec_cte(A))
    + f""", recs AS (
  SELECT p.paper_id, p.title, {O.cosine_sql('e.embedding', 'avec.q')} AS similarity
  FROM papers p JOIN emb e ON p.paper_id = e.paper_id CROSS JOIN avec
  WHERE p.paper_id NOT IN (SELECT paper_id FROM inter WHERE author_id = {A})
  ORDER BY similarity DESC, paper_id LIMIT 10),
chosen AS (SELECT title FROM recs ORDER BY similarity DESC, paper_id LIMIT 2)
SELECT author_id, kind, paper_id FROM inter WHERE author_id = {A}
UNION SELECT {A}, 'liked', paper_id FROM recs WHERE title IN (SELECT title FROM chosen)""",
)
def q_like_by_title(spark, d):
    t = TestTables(spark, d)
    recs = recommend.recommend_to_author(t.papers, t.paper_embeddings, t.interactions, A)
    chosen = recs.orderBy(F.col("similarity").desc(), "paper_id").limit(2).select("title")
    liked = P.ids_by_title(recs, chosen)
    _, inter2 = M.like_papers(t.authors, t.interactions, A, liked)
    return inter2.where(F.col("author_id") == A)


@register(
    "clear_liked",
    O.with_(O.INTER) + f"SELECT * FROM inter WHERE NOT (author_id = {A} AND kind = 'liked')",
)
def q_clear_liked(spark, d):
    return M.clear_liked(TestTables(spark, d).interactions, A)


@register(
    "delete_profile",
    O.with_(O.AUTHORS, O.INTER)
    + f"""SELECT a.author_id, a.name, count(i.author_id) AS n_edges
FROM authors a LEFT JOIN inter i ON a.author_id = i.author_id WHERE a.author_id <> {A}
GROUP BY a.author_id, a.name""",
)
def q_delete_profile(spark, d):
    t = TestTables(spark, d)
    authors2, inter2 = M.delete_profiles(t.authors, t.interactions, [A])
    return _edge_counts(authors2, inter2)


@register(
    "free_ids",
    O.with_(O.AUTHORS)
    + f"SELECT range AS author_id FROM range({M.ID_SPACE}) WHERE range NOT IN (SELECT author_id FROM authors)",
)
def q_free_ids(spark, d):
    return M.free_ids(TestTables(spark, d).authors)


@register(
    "allocated_ids",
    """SELECT count(DISTINCT user_id) AS n_ids, count(DISTINCT user_id) AS n_distinct, CAST(0 AS BIGINT) AS n_taken
FROM events""",
)
def q_allocated_ids(spark, d):
    """D8 for as many sign-ups as the events have users: how many ids, how many distinct, how many taken."""
    t = TestTables(spark, d)
    n = t.raw("events").agg(F.countDistinct("user_id").alias("n")).first().n
    ids = M.allocate_ids(t.authors, n)
    taken = t.authors.select("author_id", F.lit(1).alias("taken"))
    return ids.join(taken, "author_id", "left").agg(
        F.count("author_id").alias("n_ids"),
        F.countDistinct("author_id").alias("n_distinct"),
        F.count("taken").alias("n_taken"),
    )


# ---------------------------------------------------------------- R3, R1, R2
from refrank.plans import batch as B  # noqa: E402

AVEC_ALL = """avec AS (
  SELECT author_id, list(v ORDER BY i) AS q FROM (
    SELECT author_id, i, avg(x) AS v FROM (
      SELECT pp.author_id, unnest(range(len(e.embedding))) AS i, unnest(e.embedding) AS x
      FROM (SELECT DISTINCT author_id, paper_id FROM inter WHERE kind IN ('write', 'reference', 'liked')) pp
      JOIN emb e ON e.paper_id = pp.paper_id) u
    GROUP BY author_id, i) w
  GROUP BY author_id)"""

PAIRS_ALL = f"""pairs AS (
  SELECT a.author_id, e.paper_id, p.reference_count, p.citation_count, p.influential_citation_count, p.year,
         {O.cosine_sql('e.embedding', 'a.q')} AS similarity
  FROM avec a CROSS JOIN emb e JOIN papers p ON p.paper_id = e.paper_id
  WHERE NOT EXISTS (SELECT 1 FROM inter i WHERE i.author_id = a.author_id AND i.paper_id = e.paper_id))"""


@register(
    "global_ranks",
    O.with_(O.PAPERS)
    + """SELECT paper_id,
  CAST(row_number() OVER (ORDER BY reference_count DESC NULLS LAST, paper_id) AS BIGINT) AS ref_rank,
  CAST(row_number() OVER (ORDER BY citation_count DESC NULLS LAST, paper_id) AS BIGINT) AS cite_rank,
  CAST(row_number() OVER (ORDER BY influential_citation_count DESC NULLS LAST, paper_id) AS BIGINT) AS inf_cite_rank,
  CAST(row_number() OVER (ORDER BY year DESC NULLS LAST, paper_id) AS BIGINT) AS year_rank
FROM papers""",
)
def q_global_ranks(spark, d):
    return B.static_ranks(TestTables(spark, d).papers)


@register(
    "batch_recommend_cosine",
    O.with_(O.PAPERS, O.EMB, O.INTER, AVEC_ALL, PAIRS_ALL)
    + """SELECT author_id, paper_id, round(similarity, 6) + 0.0 AS similarity, rn FROM (
  SELECT author_id, paper_id, similarity,
         CAST(row_number() OVER (PARTITION BY author_id ORDER BY similarity DESC, paper_id) AS BIGINT) AS rn
  FROM pairs) WHERE rn <= 10""",
)
def q_batch_recommend_cosine(spark, d):
    out = B.batch_recommend_cosine(*_pei(spark, d))
    return round_doubles(out.withColumn("rn", F.col("rn").cast("bigint")))


@register(
    "batch_recommend_weighted",
    O.with_(O.PAPERS, O.EMB, O.INTER, AVEC_ALL, PAIRS_ALL)
    + """, ranked AS (
  SELECT *,
    CAST(row_number() OVER (PARTITION BY author_id ORDER BY similarity DESC, paper_id) AS BIGINT) AS cos_rank,
    CAST(row_number() OVER (PARTITION BY author_id ORDER BY reference_count DESC NULLS LAST, paper_id) AS BIGINT)
      AS ref_rank,
    CAST(row_number() OVER (PARTITION BY author_id ORDER BY citation_count DESC NULLS LAST, paper_id) AS BIGINT)
      AS cite_rank,
    CAST(row_number() OVER (PARTITION BY author_id ORDER BY influential_citation_count DESC NULLS LAST, paper_id)
      AS BIGINT) AS inf_cite_rank,
    CAST(row_number() OVER (PARTITION BY author_id ORDER BY year DESC NULLS LAST, paper_id) AS BIGINT) AS year_rank
  FROM pairs),
scored AS (
  SELECT *, 0.6::DOUBLE * cos_rank + 0.1::DOUBLE * ref_rank + 0.1::DOUBLE * cite_rank
            + 0.1::DOUBLE * inf_cite_rank + 0.1::DOUBLE * year_rank AS score FROM ranked)
SELECT author_id, paper_id, round(similarity, 6) + 0.0 AS similarity, cos_rank, ref_rank, cite_rank,
       inf_cite_rank, year_rank, round(score, 6) + 0.0 AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY author_id ORDER BY score, paper_id) AS rn FROM scored)
WHERE rn <= 10""",
)
def q_batch_recommend_weighted(spark, d):
    return round_doubles(B.batch_recommend_weighted(*_pei(spark, d)))


# The plans of large corpora on these tables: paper blocks small enough for several of them.
SMALL_BLOCK = 128


@register("batch_recommend_cosine_blocks", ORACLE["batch_recommend_cosine"])
def q_batch_recommend_cosine_blocks(spark, d):
    out = B.batch_recommend_cosine(*_pei(spark, d), paper_block=SMALL_BLOCK)
    return round_doubles(out.withColumn("rn", F.col("rn").cast("bigint")))


@register("batch_recommend_weighted_rounds", ORACLE["batch_recommend_weighted"])
def q_batch_recommend_weighted_rounds(spark, d):
    return round_doubles(B.batch_recommend_weighted(*_pei(spark, d), paper_block=SMALL_BLOCK))


@register("batch_recommend_cosine_string_ids", ORACLE["batch_recommend_cosine"])
def q_batch_recommend_cosine_string_ids(spark, d):
    """R1 with the declared id type; zero-padded, so ids of equal similarity keep their order."""
    text = lambda df, *ids: df.withColumns({c: F.lpad(F.col(c).cast("string"), 19, "0") for c in ids})
    papers, embeddings, interactions = _pei(spark, d)
    out = B.batch_recommend_cosine(
        text(papers, "paper_id"), text(embeddings, "paper_id"), text(interactions, "author_id", "paper_id"),
        paper_block=SMALL_BLOCK,
    )
    return round_doubles(out.withColumns({c: F.col(c).cast("bigint") for c in ("author_id", "paper_id", "rn")}))


# ---------------------------------------------------------------- S1 roundtrip, R4-R7 (streaming, incremental)
from refrank.sources import json_papers as J  # noqa: E402
from refrank.sources.store import append, create_table, scratch_path  # noqa: E402
from refrank.streaming import incremental as INC  # noqa: E402
from refrank.streaming.ingest import run_paper_ingest  # noqa: E402
from refrank.streaming.likes import run_like_stream  # noqa: E402

EDGES_LONG = T.StructType(
    [
        T.StructField("author_id", T.LongType()),
        T.StructField("kind", T.StringType()),
        T.StructField("paper_id", T.LongType()),
    ]
)


@register(
    "json_roundtrip_papers",
    O.with_(O.PAPERS, O.INTER, O.NESTED)
    + f"""SELECT {O.PAPER_COLS}, CAST(len(authors) AS INTEGER) AS n_authors,
  NULLIF(array_to_string(list_transform(authors, lambda x: CAST(x.authorId AS VARCHAR)), ','), '') AS author_ids,
  NULLIF(array_to_string(list_transform("references", lambda x: CAST(x.paperId AS VARCHAR)), ','), '')
    AS reference_ids
FROM nested""",
)
def q_json_roundtrip_papers(spark, d):
    nested = TestTables(spark, d).nested_papers
    landed = nested.select(
        F.col("paper_id").cast("string").alias("paperId"),
        "title",
        "abstract",
        "year",
        F.col("reference_count").alias("referenceCount"),
        F.col("citation_count").alias("citationCount"),
        F.col("influential_citation_count").alias("influentialCitationCount"),
        F.transform("authors", lambda a: F.struct(a["authorId"].cast("string").alias("authorId"), a["name"].alias("name"))).alias("authors"),
        F.transform("references", lambda r: F.struct(r["paperId"].cast("string").alias("paperId"))).alias("references"),
    )
    path = scratch_path(spark, "pages")
    J.write_paper_pages(landed, path)
    back = J.to_store_columns(J.read_paper_pages(spark, path))
    return back.select(
        F.col("paper_id").cast("bigint").alias("paper_id"),
        "title",
        "abstract",
        "year",
        "reference_count",
        "citation_count",
        "influential_citation_count",
        F.size("authors").alias("n_authors"),
        F.nullif(F.array_join(F.col("authors.authorId"), ","), F.lit("")).alias("author_ids"),
        F.nullif(F.array_join(F.col("references.paperId"), ","), F.lit("")).alias("reference_ids"),
    )


LIKES_SQL = """likes AS (
  SELECT DISTINCT user_id AS author_id, 'liked' AS kind, CAST(json_extract_string(props, '$.k') AS BIGINT) AS paper_id
  FROM events WHERE event_type = 'purchase')"""


@register("stream_likes", O.with_(LIKES_SQL) + "SELECT author_id, kind, paper_id FROM likes")
def q_stream_likes(spark, d):
    store = scratch_path(spark, "likes")
    create_table(spark, store, EDGES_LONG)
    run_like_stream(spark, f"{d.rstrip('/')}/events*.parquet", store, scratch_path(spark, "likes-stream"))
    return spark.read.schema(EDGES_LONG).parquet(store)


@register("stream_likes_out_of_order", O.with_(LIKES_SQL) + "SELECT author_id, kind, paper_id FROM likes")
def q_stream_likes_out_of_order(spark, d):
    """R4 over several micro-batches whose files arrive newest first: every late like is stored."""
    landing, store = scratch_path(spark, "late-events"), scratch_path(spark, "late-likes")
    events = TestTables(spark, d).raw("events")
    events.repartitionByRange(4, F.col("ts").desc()).sortWithinPartitions(F.col("ts").desc()).write.parquet(landing)
    create_table(spark, store, EDGES_LONG)
    run_like_stream(spark, landing, store, scratch_path(spark, "late-stream"), max_files=1)
    return spark.read.schema(EDGES_LONG).parquet(store)


RAW_SCHEMA = T.StructType(
    [
        T.StructField("paper_id", T.LongType()),
        T.StructField("pos", T.LongType()),
        T.StructField("title", T.StringType()),
    ]
)


@register(
    "stream_ingest_papers",
    O.with_(O.RAW)
    + """SELECT paper_id, arg_min(pos, pos) AS pos, arg_min(title, pos) AS title FROM raw GROUP BY paper_id""",
)
def q_stream_ingest_papers(spark, d):
    t = TestTables(spark, d)
    landing = scratch_path(spark, "landing")
    orders = t.raw("orders").select("o_orderkey", F.year("o_orderdate").alias("_y"))
    (
        t.raw_papers.join(orders, F.col("pos") == F.col("o_orderkey"))
        .repartition("_y")
        .select("paper_id", "pos", "title")
        .write.json(landing)
    )
    store = scratch_path(spark, "papers")
    create_table(spark, store, RAW_SCHEMA)
    run_paper_ingest(spark, landing, RAW_SCHEMA, store, scratch_path(spark, "ingest-stream"))
    return spark.read.schema(RAW_SCHEMA).parquet(store)


CONTENT_SEG_SQL = f"""cseg AS (
  SELECT paper_id, CAST(start // {SEGMENT_STEP} AS BIGINT) AS seg_idx,
         substring(content, start + 1, {SEGMENT_WIDTH}) AS segment
  FROM (SELECT paper_id, content, unnest(range(0, length(content), {SEGMENT_STEP})) AS start
        FROM (SELECT paper_id, title || COALESCE(abstract, '') AS content FROM papers)))"""

EMB_SCHEMA = T.StructType(
    [
        T.StructField("paper_id", T.LongType()),
        T.StructField("content_sha", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.DoubleType())),
    ]
)


@register(
    "incremental_embedding",
    O.with_(O.PAPERS, CONTENT_SEG_SQL)
    + f"""SELECT paper_id, CAST(bucket AS BIGINT) AS bucket, count(*) / {float(DEFAULT_DIM)} AS value
FROM ({tok_bucket_sql('segment', 'paper_id, seg_idx', 'cseg')}) GROUP BY paper_id, bucket""",
)
def q_incremental_embedding(spark, d):
    papers = TestTables(spark, d).papers
    store = scratch_path(spark, "embeddings")
    create_table(spark, store, EMB_SCHEMA)

    def stored():
        return spark.read.schema(EMB_SCHEMA).parquet(store)

    append(INC.embed_new_content(papers.where(F.col("year") <= 2005), stored()), store)  # first load
    append(INC.embed_new_content(papers, stored()), store)  # incremental: only unseen content
    live = INC.latest_embeddings(stored(), papers)
    return round_doubles(
        explode_vector(live, "paper_id").where(F.col("value") != 0).select(
            "paper_id", F.col("idx").alias("bucket"), "value"
        )
    )


@register(
    "incremental_profile",
    O.with_(O.EMB, LIKES_SQL)
    + """, inter AS (SELECT * FROM (""" + O.INTER.split("AS (", 1)[1] + """ UNION SELECT author_id, kind, paper_id FROM likes)
SELECT author_id, CAST(i AS BIGINT) AS idx, round(avg(x), 6) + 0.0 AS value FROM (
  SELECT pp.author_id, unnest(range(len(e.embedding))) AS i, unnest(e.embedding) AS x
  FROM (SELECT DISTINCT author_id, paper_id FROM inter WHERE kind IN ('write', 'reference', 'liked')) pp
  JOIN emb e ON e.paper_id = pp.paper_id) u
GROUP BY author_id, i""",
)
def q_incremental_profile(spark, d):
    from refrank.operators.mutations import new_edges
    from refrank.session import cut_lineage

    t = TestTables(spark, d)
    stored = cut_lineage(PR.author_vectors(t.interactions, t.paper_embeddings).select("author_id", "embedding"))
    batch = t.like_events.select("author_id", F.lit("liked").alias("kind"), "paper_id").distinct()
    inter2 = t.interactions.unionByName(new_edges(t.interactions, batch))
    fresh = INC.refresh_profiles(stored, inter2, batch, t.paper_embeddings)
    return round_doubles(explode_vector(fresh, "author_id"))


# ---------------------------------------------------------------- C7, T4
from refrank.plans.initialize import initialize as _initialize  # noqa: E402

PAGE_OFFSET, PAGE_SIZE = 100, 50


@register(
    "initialize_store",
    O.with_(O.PAPERS, O.INTER, O.NESTED)
    + """, a AS (
  SELECT paper_id, "references", unnest(authors) AS au, generate_subscripts(authors, 1) AS author_pos FROM nested),
edges AS (
  SELECT DISTINCT au.authorId AS author_id, 'write' AS kind, paper_id FROM a WHERE au.authorId IS NOT NULL
  UNION
  SELECT DISTINCT author_id, 'reference', ref FROM (
    SELECT au.authorId AS author_id, unnest("references").paperId AS ref FROM a WHERE au.authorId IS NOT NULL) r
  WHERE ref IS NOT NULL),
names AS (SELECT au.authorId AS author_id, arg_min(au.name, paper_id * 100000 + author_pos) AS name
          FROM a WHERE au.authorId IS NOT NULL GROUP BY au.authorId)
SELECT CAST(e.author_id AS VARCHAR) AS author_id, n.name, e.kind, CAST(e.paper_id AS VARCHAR) AS paper_id
FROM edges e JOIN names n ON e.author_id = n.author_id""",
)
def q_initialize_store(spark, d):
    """C7 end to end: nested papers landed as JSON pages (string ids, as the API lands them), then
    initialise papers, authors, interactions and embeddings from the pages."""
    nested = TestTables(spark, d).nested_papers
    landed = nested.select(
        F.col("paper_id").alias("_crawl_order"),
        F.col("paper_id").cast("string").alias("paperId"), "title", "abstract", "year",
        F.col("reference_count").alias("referenceCount"), F.col("citation_count").alias("citationCount"),
        F.col("influential_citation_count").alias("influentialCitationCount"),
        F.transform("authors", lambda a: F.struct(a["authorId"].cast("string").alias("authorId"), a["name"].alias("name"))).alias("authors"),
        F.transform("references", lambda r: F.struct(r["paperId"].cast("string").alias("paperId"))).alias("references"),
    )
    pages = scratch_path(spark, "init-pages")
    # Pages as an ordered crawl (ranges of the id), so scan order (file, pos) is the fixture's
    # first-seen order (lowest paper id first).
    J.write_paper_pages(landed, pages, page_key="_crawl_order", sort_key="_crawl_order")
    tables = _initialize(spark, pages, scratch_path(spark, "init-store"))
    return tables["interactions"].join(tables["authors"], "author_id").select("author_id", "name", "kind", "paper_id")


@register(
    "papers_page",
    O.with_(O.PAPERS) + f"SELECT {O.PAPER_COLS} FROM papers ORDER BY paper_id LIMIT {PAGE_SIZE} OFFSET {PAGE_OFFSET}",
)
def q_papers_page(spark, d):
    return P.page(TestTables(spark, d).papers.select(*O.PAPER_COLS.split(", ")), PAGE_OFFSET, PAGE_SIZE)


# ---------------------------------------------------------------- C3 against a static-rank index
@register("recommend_weighted_indexed", O.recommend_weighted_sql())
def q_recommend_weighted_indexed(spark, d):
    from refrank.plans.indexed import recommend_weighted_indexed, static_rank_index

    papers, emb, inter = _pei(spark, d)
    index = static_rank_index(papers, emb)  # built once per data version in production
    return round_doubles(recommend_weighted_indexed(papers, emb, inter, A, index))
