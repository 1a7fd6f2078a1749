"""Connected components by alternating star contraction, as DataFrame joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refrank.llm.base import materialise


def star_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a bigint, b bigint) that is not its component's root.

    Each round rewires every node's larger neighbours to its smallest neighbour (large star), then
    every node and its smaller neighbours to the smallest of them (small star); the number of rounds
    is logarithmic in practice. Minima are pre-aggregated before each shuffle and come back by a join,
    which adaptive execution can split on a hot hub; no neighbourhood is gathered in one place.
    """
    edges = materialise(
        links.where("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        edges = materialise(
            large.join(small, "u")
            .where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(small.select("u", F.col("m").alias("v")))
            .distinct()
        )
        row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if (row.n, row.x) == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = (row.n, row.x)
