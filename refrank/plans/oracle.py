"""Independent DuckDB SQL for every registered query (the correctness oracle).

The CTEs re-derive the recommender tables from the raw test tables exactly as
``refrank.sources.testdata`` does, then each query is written the plain SQL way (global windows,
NOT IN, per-index averages) so it checks the distributed Spark forms.
"""

from __future__ import annotations

# Author and keyword the single-target queries are run for.
FLAGSHIP_AUTHOR = 7

PAPERS = """papers AS (
  SELECT p.p_partkey AS paper_id, p.p_name AS title,
         CASE WHEN p.p_partkey % 5 = 0 THEN NULL ELSE p.p_type END AS abstract,
         CASE WHEN p.p_partkey % 17 = 0 THEN NULL
              ELSE CAST(1990 + (p.p_partkey * 7) % 34 AS INTEGER) END AS year,
         CAST(p.p_size AS BIGINT) AS reference_count,
         COALESCE(l.citation_count, 0) AS citation_count,
         COALESCE(l.influential_citation_count, 0) AS influential_citation_count
  FROM part p LEFT JOIN (
    SELECT l_partkey, COUNT(*) AS citation_count,
           COUNT(CASE WHEN l_returnflag = 'R' THEN 1 END) AS influential_citation_count
    FROM lineitem GROUP BY l_partkey) l ON p.p_partkey = l.l_partkey)"""

EMB = """emb AS (SELECT vec_id AS paper_id, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings
         WHERE embedding IS NOT NULL)"""

AUTHORS = """authors AS (SELECT c_custkey AS author_id, c_name AS name FROM customer)"""

INTER = """inter AS (
  SELECT DISTINCT o.o_custkey AS author_id,
         CASE l.l_returnflag WHEN 'N' THEN 'write' WHEN 'A' THEN 'reference'
                             WHEN 'R' THEN 'liked' END AS kind,
         l.l_partkey AS paper_id
  FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey)"""

NESTED = """nested AS (
  SELECT p.*, COALESCE(w.authors, []) AS authors,
         [{'paperId': (p.paper_id * 3 + 1) % n.n},
          {'paperId': CASE WHEN p.paper_id % 11 = 0 THEN NULL ELSE (p.paper_id * 5 + 2) % n.n END}]
           AS "references"
  FROM papers p CROSS JOIN (SELECT count(*) AS n FROM part) n
  LEFT JOIN (
    SELECT paper_id,
           list({'authorId': CASE WHEN author_id % 13 = 0 THEN NULL ELSE author_id END,
                 'name': 'A' || author_id || '#' || (paper_id % 3)} ORDER BY author_id) AS authors
    FROM inter WHERE kind = 'write' GROUP BY paper_id) w ON p.paper_id = w.paper_id)"""

RAW = """raw AS (SELECT o_custkey AS paper_id, o_orderkey AS pos, o_orderpriority AS title, o_orderdate
         FROM orders)"""

PAPER_COLS = (
    "paper_id, title, abstract, year, reference_count, citation_count, influential_citation_count"
)


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def author_vec_cte(author_id: int, name: str = "avec") -> str:
    """Per-index average of the author's distinct write/reference/liked papers with an embedding."""
    return f"""{name} AS (
  SELECT list(v ORDER BY i) AS q FROM (
    SELECT i, avg(x) AS v FROM (
      SELECT unnest(range(len(e.embedding))) AS i, unnest(e.embedding) AS x
      FROM emb e JOIN (SELECT DISTINCT paper_id FROM inter
                       WHERE author_id = {author_id} AND kind IN ('write', 'reference', 'liked')) pp
           ON e.paper_id = pp.paper_id) u
    GROUP BY i) w)"""


def cosine_sql(a: str, b: str) -> str:
    na = f"sqrt(list_dot_product({a}, {a}))"
    nb = f"sqrt(list_dot_product({b}, {b}))"
    return f"(CASE WHEN {na} * {nb} = 0 THEN 0.0 ELSE list_dot_product({a}, {b}) / ({na} * {nb}) END)"


def recommend_weighted_sql(author_id: int = FLAGSHIP_AUTHOR, w=(0.6, 0.1, 0.1, 0.1, 0.1), k: int = 10) -> str:
    score = " + ".join(
        f"{x!r}::DOUBLE * {r}"
        for x, r in zip(w, ("cos_rank", "ref_rank", "cite_rank", "inf_cite_rank", "year_rank"))
    )
    return with_(PAPERS, EMB, INTER, author_vec_cte(author_id)) + f""",
cand AS (
  SELECT p.*, {cosine_sql('e.embedding', 'avec.q')} AS similarity
  FROM papers p JOIN emb e ON p.paper_id = e.paper_id CROSS JOIN avec
  WHERE p.paper_id NOT IN (SELECT paper_id FROM inter WHERE author_id = {author_id})),
ranked AS (
  SELECT *,
    CAST(row_number() OVER (ORDER BY similarity DESC, paper_id) AS BIGINT) AS cos_rank,
    CAST(row_number() OVER (ORDER BY reference_count DESC NULLS LAST, paper_id) AS BIGINT) AS ref_rank,
    CAST(row_number() OVER (ORDER BY citation_count DESC NULLS LAST, paper_id) AS BIGINT) AS cite_rank,
    CAST(row_number() OVER (ORDER BY influential_citation_count DESC NULLS LAST, paper_id) AS BIGINT)
      AS inf_cite_rank,
    CAST(row_number() OVER (ORDER BY year DESC NULLS LAST, paper_id) AS BIGINT) AS year_rank
  FROM cand)
SELECT {PAPER_COLS}, round(similarity, 6) + 0.0 AS similarity,
       cos_rank, ref_rank, cite_rank, inf_cite_rank, year_rank, round({score}, 6) + 0.0 AS rank
FROM ranked ORDER BY {score}, paper_id LIMIT {k}"""


def recommend_cosine_sql(author_id: int = FLAGSHIP_AUTHOR, k: int = 10) -> str:
    return with_(PAPERS, EMB, INTER, author_vec_cte(author_id)) + f"""
SELECT {PAPER_COLS}, round(similarity, 6) + 0.0 AS similarity FROM (
  SELECT p.*, {cosine_sql('e.embedding', 'avec.q')} AS similarity
  FROM papers p JOIN emb e ON p.paper_id = e.paper_id CROSS JOIN avec
  WHERE p.paper_id NOT IN (SELECT paper_id FROM inter WHERE author_id = {author_id}))
ORDER BY similarity DESC, paper_id LIMIT {k}"""


def order_by_field_sql(field: str, ascending: bool = False, k: int = 10) -> str:
    order = "ASC NULLS FIRST" if ascending else "DESC NULLS LAST"
    return with_(PAPERS) + f"SELECT {PAPER_COLS} FROM papers ORDER BY {field} {order}, paper_id LIMIT {k}"
