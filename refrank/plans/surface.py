"""Registered queries of the composite and connector surface: results with whole paper rows as they are
shown, mutations that are written and read back, sources, SQL functions and pluggable embedders.

Importing this module adds them to ``refrank.plans.queries.QUERIES`` and ``ORACLE``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refrank.functions.text import DEFAULT_DIM
from refrank.functions.vectors import vector_add, vector_scale
from refrank.operators import mutations as M
from refrank.operators import papers as P
from refrank.operators import profiles as PR
from refrank.operators.embedding import BatchEmbedder
from refrank.plans import batch as B
from refrank.plans import oracle as O
from refrank.plans import queries as Q
from refrank.plans import recommend
from refrank.plans import sql as SQL
from refrank.plans.initialize import initialize
from refrank.plans.profile_pages import author_page, find_and_recommend
from refrank.plans.queries import ORACLE as ORACLE
from refrank.plans.queries import QUERIES as QUERIES
from refrank.plans.queries import A, explode_vector, register, round_doubles
from refrank.plans.search import keyword_buckets, search_papers
from refrank.sources import json_papers as J
from refrank.sources.store import persist, scratch_path
from refrank.sources.testdata import TestTables

# ---------------------------------------------------------------- C2-C5 with P10: rows as they are shown
SHOWN = """array_to_string(list_transform(authors, lambda x: x.name), ', ') AS author_names,
       array_to_string(list_transform("references", lambda x: CAST(x.paperId AS VARCHAR)), ',') AS reference_ids"""


def _shown(result: DataFrame) -> DataFrame:
    """Display projection, its lists as text so that values compare across engines."""
    shown = P.display_projection(result)
    return shown.select(
        *[c for c in shown.columns if c not in ("authors", "references")],
        F.array_join("authors", ", ").alias("author_names"),
        F.array_join(F.transform("references", lambda x: x.cast("string")), ",").alias("reference_ids"),
    )


def _shown_sql(rows: str, more: str = "") -> str:
    """``rows`` (a query with a paper_id and ``more`` columns) joined to what is shown of its papers."""
    cols = ", ".join(f"r.{c}" for c in more.split(", ")) + ", " if more else ""
    return f"""SELECT {cols}{", ".join("n." + c for c in O.PAPER_COLS.split(", "))}, {SHOWN}
FROM ({rows}) r JOIN nested n ON r.paper_id = n.paper_id"""


@register(
    "recommend_cosine_shown",
    O.with_(O.PAPERS, O.INTER, O.NESTED, f"c AS ({O.recommend_cosine_sql()})")
    + _shown_sql("SELECT * FROM c", "similarity"),
)
def q_recommend_cosine_shown(spark, d):
    t = TestTables(spark, d)
    out = recommend.recommend_to_author(t.nested_papers, t.paper_embeddings, t.interactions, A)
    return _shown(round_doubles(out))


@register(
    "recommend_weighted_shown",
    O.with_(O.PAPERS, O.INTER, O.NESTED, f"c AS ({O.recommend_weighted_sql()})")
    + _shown_sql("SELECT * FROM c", "similarity, cos_rank, ref_rank, cite_rank, inf_cite_rank, year_rank, rank"),
)
def q_recommend_weighted_shown(spark, d):
    t = TestTables(spark, d)
    out = recommend.recommend_weighted(t.nested_papers, t.paper_embeddings, t.interactions, A)
    return _shown(round_doubles(out))


@register(
    "top_cited_shown",
    O.with_(O.PAPERS, O.INTER, O.NESTED, f"c AS ({O.order_by_field_sql('citation_count')})")
    + _shown_sql("SELECT * FROM c"),
)
def q_top_cited_shown(spark, d):
    return _shown(recommend.most_cited(TestTables(spark, d).nested_papers))


@register(
    "author_page_shown",
    O.with_(O.PAPERS, O.AUTHORS, O.INTER, O.NESTED)
    + _shown_sql(
        f"""SELECT a.author_id, a.name, i.kind, i.paper_id FROM authors a
JOIN inter i ON i.author_id = a.author_id WHERE a.author_id = {A}""",
        "author_id, name, kind",
    ),
)
def q_author_page_shown(spark, d):
    t = TestTables(spark, d)
    return _shown(author_page(t.authors, t.interactions, t.nested_papers, A))


# ---------------------------------------------------------------- C6, U5, F3
OTHER_WEIGHTS = (0.5, 0.2, 0.2, 0.1, 0.1)  # do not sum to one: a warning, and the ranking runs


@register("find_and_recommend", O.recommend_weighted_sql(A, OTHER_WEIGHTS))
def q_find_and_recommend(spark, d):
    t = TestTables(spark, d)
    name = f"customer#{A:09d}"
    out = find_and_recommend(
        t.authors, t.papers, t.paper_embeddings, t.interactions, name, "weighted", OTHER_WEIGHTS
    )
    return round_doubles(out)


# ---------------------------------------------------------------- C1 over stored paper embeddings
@register(
    "search_papers",
    O.with_(
        O.PAPERS, O.EMB,
        f"""tok AS ({Q.tok_bucket_sql('q', 'q', "(SELECT '" + Q.KEYWORD + "' AS q)")})""",
        f"""qv AS (SELECT list(coalesce(n, 0)::DOUBLE ORDER BY b) AS q
  FROM range({DEFAULT_DIM}) g(b) LEFT JOIN (SELECT bucket, count(*) AS n FROM tok GROUP BY bucket) c ON c.bucket = g.b)""",
    )
    + f"""SELECT {O.PAPER_COLS}, round(similarity, 6) + 0.0 AS similarity FROM (
  SELECT p.*, {O.cosine_sql('e.embedding', 'qv.q')} AS similarity
  FROM papers p JOIN emb e ON p.paper_id = e.paper_id CROSS JOIN qv)
ORDER BY similarity DESC, paper_id LIMIT 10""",
)
def q_search_papers(spark, d):
    t = TestTables(spark, d)
    return round_doubles(search_papers(t.papers, t.paper_embeddings, Q.KEYWORD))


# ---------------------------------------------------------------- J4, T4, F6
@register(
    "missing_embeddings",
    O.with_(O.EMB, O.INTER)
    + """SELECT DISTINCT author_id, paper_id FROM inter
WHERE kind IN ('write', 'reference', 'liked') AND paper_id NOT IN (SELECT paper_id FROM emb)""",
)
def q_missing_embeddings(spark, d):
    t = TestTables(spark, d)
    return PR.missing_embeddings(t.interactions, t.paper_embeddings)


@register(
    "papers_page_after",
    O.with_(O.PAPERS)
    + f"SELECT {O.PAPER_COLS} FROM papers WHERE paper_id > {Q.PAGE_OFFSET} ORDER BY paper_id LIMIT {Q.PAGE_SIZE}",
)
def q_papers_page_after(spark, d):
    return P.page_after(TestTables(spark, d).papers, Q.PAGE_OFFSET, Q.PAGE_SIZE)


@register(
    "vector_arithmetic",
    O.with_(O.EMB)
    + """SELECT paper_id, CAST(idx AS BIGINT) AS idx, round(x * 0.5 + x, 6) + 0.0 AS value FROM (
  SELECT paper_id, unnest(range(len(embedding))) AS idx, unnest(embedding) AS x FROM emb)""",
)
def q_vector_arithmetic(spark, d):
    emb = TestTables(spark, d).paper_embeddings
    out = emb.select("paper_id", vector_add(vector_scale("embedding", 0.5), "embedding").alias("embedding"))
    return round_doubles(explode_vector(out, "paper_id"))


# ---------------------------------------------------------------- D3-D7 written and read back
CLEARED, DELETED = 8, 9


@register(
    "profile_life_cycle",
    Q.ORACLE["profile_upsert"].split("SELECT x.author_id, x.name, e.kind", 1)[0].rstrip()
    + f""",
top AS (SELECT paper_id FROM papers ORDER BY citation_count DESC NULLS LAST, paper_id LIMIT 10),
edges AS (SELECT * FROM all_edges UNION SELECT {A}, 'liked', paper_id FROM top)
SELECT x.author_id, x.name, e.kind, e.paper_id FROM all_authors x LEFT JOIN (
  SELECT * FROM edges WHERE NOT (author_id = {CLEARED} AND kind = 'liked')) e ON x.author_id = e.author_id
WHERE x.author_id <> {DELETED}""",
)
def q_profile_life_cycle(spark, d):
    """Update, like, clear, delete: every step writes the next version and the following one reads it."""
    t = TestTables(spark, d)
    nested = persist(t.nested_papers, "nested")  # names, edges and the most cited come from it
    batch = PR.profiles_from_papers(nested)
    authors, edges = M.upsert_profiles(t.authors, t.interactions, *batch, trim=False)
    authors, edges = persist(authors, "authors"), persist(edges, "edges")
    liked = recommend.most_cited(nested).select("paper_id")
    edges = persist(M.like_papers(authors, edges, A, liked)[1], "edges")
    edges = persist(M.clear_liked(edges, CLEARED), "edges")
    authors, edges = (persist(x, "deleted") for x in M.delete_profiles(authors, edges, [DELETED]))
    return authors.join(edges, "author_id", "left").select("author_id", "name", "kind", "paper_id")


# ---------------------------------------------------------------- S2, S4, C7, S9/U1/U2, U6
def _landed(nested: DataFrame, *more: Column) -> DataFrame:
    """Nested papers as the search interface lands them: camelCase names and string ids; ``more`` columns go along."""
    return nested.select(
        F.col("paper_id").cast("string").alias("paperId"), "title", "abstract", "year",
        F.col("reference_count").alias("referenceCount"), F.col("citation_count").alias("citationCount"),
        F.col("influential_citation_count").alias("influentialCitationCount"),
        F.transform("authors", lambda a: F.struct(a["authorId"].cast("string").alias("authorId"), a["name"].alias("name"))).alias("authors"),
        F.transform("references", lambda r: F.struct(r["paperId"].cast("string").alias("paperId"))).alias("references"),
        *more,
    )


@register("release_papers", Q.ORACLE["json_roundtrip_papers"])
def q_release_papers(spark, d):
    """A release of gzipped JSON lines, read back."""
    path = scratch_path(spark, "release")
    _landed(TestTables(spark, d).nested_papers).write.option("compression", "gzip").json(path)
    back = J.to_store_columns(J.read_release(spark, path))
    ids = lambda c: F.nullif(F.array_join(F.col(c), ","), F.lit(""))
    return back.select(
        F.col("paper_id").cast("bigint").alias("paper_id"),
        *[c for c in O.PAPER_COLS.split(", ") if c != "paper_id"],
        F.size("authors").alias("n_authors"),
        ids("authors.authorId").alias("author_ids"),
        ids("references.paperId").alias("reference_ids"),
    )


@register(
    "vector_responses",
    O.with_(O.EMB)
    + """SELECT paper_id, CAST(idx AS BIGINT) AS idx, round(x, 6) + 0.0 AS value FROM (
  SELECT paper_id, unnest(range(len(embedding))) AS idx, unnest(embedding) AS x FROM emb)""",
)
def q_vector_responses(spark, d):
    """Landed vector responses, read back."""
    path = scratch_path(spark, "vectors")
    vector = F.struct(F.lit("m").alias("model"), F.col("embedding").alias("vector"))
    emb = TestTables(spark, d).paper_embeddings
    emb.select(F.col("paper_id").cast("string").alias("paperId"), vector.alias("embedding")).write.json(path)
    back = J.read_vector_responses(spark, path).withColumn("paper_id", F.col("paper_id").cast("bigint"))
    return round_doubles(explode_vector(back, "paper_id"))


@register(
    "initialize_embeddings",
    O.with_(O.PAPERS, Q.CONTENT_SEG_SQL)
    + f""", n AS (SELECT paper_id, count(*) AS tokens, count(DISTINCT bucket) AS buckets
  FROM ({Q.tok_bucket_sql('segment', 'paper_id, seg_idx', 'cseg')}) GROUP BY paper_id)
SELECT {", ".join("p." + c for c in O.PAPER_COLS.split(", "))}, round(n.tokens / {float(DEFAULT_DIM)}, 6) + 0.0 AS mass,
  n.buckets FROM papers p LEFT JOIN n ON p.paper_id = n.paper_id""",
)
def q_initialize_embeddings(spark, d):
    """The papers and embeddings tables that landed pages initialise (``initialize_store``: the others)."""
    pages = scratch_path(spark, "init-pages")
    J.write_paper_pages(_landed(TestTables(spark, d).nested_papers), pages)
    tables = initialize(spark, pages, scratch_path(spark, "init-store"))
    parts = (
        tables["paper_embeddings"]
        .select("paper_id", F.explode("embedding").alias("x"))
        .groupBy("paper_id")
        .agg(F.sum("x").alias("mass"), F.count(F.when(F.col("x") != 0, 1)).alias("buckets"))
    )
    out = tables["papers"].join(parts, "paper_id", "left").withColumn("paper_id", F.col("paper_id").cast("bigint"))
    return round_doubles(out.select(*O.PAPER_COLS.split(", "), "mass", "buckets"))


@register(
    "sql_functions",
    O.with_(O.PAPERS, O.EMB, O.INTER, O.author_vec_cte(A))
    + f"""SELECT p.paper_id, round({O.cosine_sql('e.embedding', 'avec.q')}, 6) + 0.0 AS similarity,
  round(0.6 * p.citation_count + 0.1 * p.reference_count + 0.1 * p.citation_count
        + 0.1 * p.influential_citation_count + 0.1 * p.year, 6) + 0.0 AS score
FROM papers p JOIN emb e ON p.paper_id = e.paper_id CROSS JOIN avec""",
)
def q_sql_functions(spark, d):
    """Views, both registered functions and a named parameter."""
    t = TestTables(spark, d)
    SQL.register_functions(spark)
    SQL.register_views(
        {"papers": t.papers, "paper_embeddings": t.paper_embeddings, "author_vectors": PR.author_vectors(t.interactions, t.paper_embeddings)}
    )
    text = """SELECT p.paper_id,
  cosine_similarity(e.embedding, (SELECT embedding FROM author_vectors WHERE author_id = :author)) AS similarity,
  linear_combination_score(p.citation_count, p.reference_count, p.citation_count, p.influential_citation_count, p.year) AS score
FROM papers p JOIN paper_embeddings e ON p.paper_id = e.paper_id WHERE e.embedding IS NOT NULL"""
    return round_doubles(SQL.query(spark, text, author=A))


def _count_tokens(texts: list[str]) -> list[list[float]]:
    """A batch model for ``BatchEmbedder``: hashed token counts, as the default embedder makes them."""
    found = (keyword_buckets(t) for t in texts)
    return [[float(f.get(b, 0)) for b in range(DEFAULT_DIM)] for f in found]


@register("batch_embedder", Q.ORACLE["segment_pooling"])
def q_batch_embedder(spark, d):
    """A user-supplied batch model over the segments of every text."""
    pooled = BatchEmbedder(_count_tokens, DEFAULT_DIM).embed(TestTables(spark, d).documents, "doc_id", "text")
    long = explode_vector(pooled, "doc_id").where(F.col("value") != 0)
    return round_doubles(long.select("doc_id", F.col("idx").cast("int").alias("bucket"), "value"))


# ---------------------------------------------------------------- R2 with the declared id type
@register("batch_recommend_weighted_string_ids", Q.ORACLE["batch_recommend_weighted"])
def q_batch_recommend_weighted_string_ids(spark, d):
    text = lambda df, *ids: df.withColumns({c: F.lpad(F.col(c).cast("string"), 19, "0") for c in ids})
    t = TestTables(spark, d)
    out = B.batch_recommend_weighted(
        text(t.papers, "paper_id"), text(t.paper_embeddings, "paper_id"), text(t.interactions, "author_id", "paper_id"),
        paper_block=Q.SMALL_BLOCK,
    )
    return round_doubles(out.withColumns({c: F.col(c).cast("bigint") for c in ("author_id", "paper_id")}))
