"""D8/D4 for any number of sign-ups at once: unused ids at random, spread over tasks.

The id space is cut into ranges and the free ids of each are counted, so the p-th free id lies in a known range at a
known place. The i-th sign-up gets the free id number ``perm(i)``, where ``perm`` is a keyed permutation of
0..free-1: ids are distinct without a check, unused, and look random, and no task orders or limits them all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from refrank.operators.mutations import ID_SPACE
from refrank.operators.ranking import global_row_number

LEAST_RANGE = 1 << 12
MAX_RANGES = 1 << 14  # counts of free ids that the driver holds
ROUNDS = 4
U = np.uint64


def permuted(i: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The images of ``i`` under a permutation of 0..n-1: a Feistel network on the next even power of two, walked on
    until it falls below n (four steps on average at most)."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask = U((1 << half) - 1)
    keys = np.random.default_rng(seed).integers(1, 1 << 63, ROUNDS, dtype=np.uint64)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> U(half), x & mask
        for k in keys:
            f = (right + k) * U(0x9E3779B97F4A7C15)
            f = (f ^ (f >> U(29))) * U(0xBF58476D1CE4E5B9)
            left, right = right, left ^ (f >> U(64 - half))
        return (left << U(half)) | right

    out = once(i.astype(np.uint64))
    while (over := out >= U(n)).any():
        out[over] = once(out[over])
    return out.astype(np.int64)


def allocate_ids(authors: DataFrame, n: int, seed: int = 0, id_space: int = ID_SPACE) -> DataFrame:
    """(i, author_id) for i = 0..n-1: distinct ids that no author holds.

    The space grows when authors fill it (``max(id_space, authors + n)`` always has n free ids). Ids of authors that
    are no integers, or lie outside the space, take no place in it; repeated ones take one."""
    spark, kind = authors.sparkSession, authors.schema["author_id"].dataType
    schema = T.StructType([T.StructField("i", T.LongType()), T.StructField("author_id", kind)])
    if n <= 0:
        return spark.createDataFrame([], schema)
    space = max(id_space, authors.count() + n)
    width = max(LEAST_RANGE, -(-space // MAX_RANGES))
    number = F.col("author_id").try_cast("bigint")
    taken = authors.select(number.alias("id")).where((F.col("id") >= 0) & (F.col("id") < space)).distinct()
    taken = taken.select(F.expr(f"id div {width}").alias("range"), F.expr(f"cast(id % {width} as int)").alias("at"))
    sizes = np.full(-(-space // width), width, np.int64)
    sizes[-1] = space - width * (len(sizes) - 1)
    for r in taken.groupBy("range").count().collect():  # MAX_RANGES lines at most
        sizes[r.range] -= r["count"]
    before = np.concatenate(([0], np.cumsum(sizes)))  # free ids in the ranges ahead
    free = int(before[-1])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nth = permuted(b.column(0).to_numpy(), free, seed)
            where = np.searchsorted(before, nth, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(where), pa.array((nth - before[where]).astype(np.int32))], ["i", "range", "nth"]
            )

    def pick(asked: pa.Table, held: pa.Table) -> pa.Table:
        unused = np.ones(width, bool)
        unused[held["at"].to_numpy()] = False
        ids = np.flatnonzero(unused)
        base = asked["range"].to_numpy().astype(np.int64) * width
        return pa.table({"i": asked["i"], "id": pa.array(base + ids[asked["nth"].to_numpy()])})

    asked = spark.range(n).mapInArrow(ask, "i long, range long, nth int")
    found = asked.groupBy("range").cogroup(taken.groupBy("range")).applyInArrow(pick, "i long, id long")
    return found.select("i", F.col("id").cast(kind).alias("author_id"))


def sign_up_ids(signups: DataFrame, authors: DataFrame, order: list[str], seed: int = 0, id_space: int = ID_SPACE) -> DataFrame:
    """``signups`` with an unused ``author_id`` each; ``order`` is a total order of them."""
    numbered = global_row_number(signups, order, "_i").withColumn("_i", F.col("_i") - 1)
    ids = allocate_ids(authors, signups.count(), seed, id_space).withColumnRenamed("i", "_i")
    return numbered.join(ids, "_i").drop("_i")
