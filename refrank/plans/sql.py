"""SQL surface (S9, U1, U2): temp views over the tables, parameterised queries, and the two scalar
functions as SQL-bodied temporary functions — inlined into the plan, evaluated in the JVM."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from refrank.functions.vectors import DEFAULT_WEIGHTS, check_weights

_SUMSQ = "aggregate({v}, 0D, (s, x) -> s + x * x)"


def register_views(tables: Mapping[str, DataFrame]) -> None:
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def register_functions(spark: SparkSession, weights: Sequence[float] = DEFAULT_WEIGHTS) -> None:
    """``cosine_similarity(a, b)`` (0 for a zero vector) and
    ``linear_combination_score(cos_rank, ref_rank, cite_rank, inf_cite_rank, year_rank)`` with the
    given weights baked in (re-register to change them)."""
    check_weights(weights)
    na, nb = _SUMSQ.format(v="a"), _SUMSQ.format(v="b")
    spark.sql(
        f"""CREATE OR REPLACE TEMPORARY FUNCTION cosine_similarity(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>)
        RETURNS DOUBLE RETURN CASE WHEN sqrt({na}) * sqrt({nb}) = 0 THEN 0D
        ELSE aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x) / (sqrt({na}) * sqrt({nb})) END"""
    )
    w = [f"CAST({float(x)!r} AS DOUBLE)" for x in weights]
    spark.sql(
        f"""CREATE OR REPLACE TEMPORARY FUNCTION linear_combination_score(
          cos_rank BIGINT, ref_rank BIGINT, cite_rank BIGINT, inf_cite_rank BIGINT, year_rank BIGINT)
        RETURNS DOUBLE RETURN {w[0]} * cos_rank + {w[1]} * ref_rank + {w[2]} * cite_rank
                              + {w[3]} * inf_cite_rank + {w[4]} * year_rank"""
    )


def query(spark: SparkSession, sql: str, **params) -> DataFrame:
    """Run SQL with named parameters (``:name``) — values never formatted into the text."""
    return spark.sql(sql, args=params)
