"""Maintained order statistics: exact ranks of a table under one numeric field, kept up under inserts.

The rows are stored in ranges of the order (the field, then the id), each row with its position in its range; a
directory keeps the first key and the number of rows of every range. The rank of a row is the rows of all
ranges before its own plus its position, so

* an insert rewrites only the ranges it falls into; every later rank moves by the directory alone;
* ranks are read without a sort or a shuffle;
* a page at any depth reads the one or two ranges that hold it.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from refrank.operators.ranking import segmented_row_number
from refrank.session import cut_lineage
from refrank.sources.parts import new_part, read_directory, read_parts, write_directory, write_parts

RANGE_ROWS = 100_000
ORDER = ["_np", "_v", "_x"]  # place of NULL, signed value, exact integer; then the key


@dataclass
class RankStore:
    """``lines`` are (part, rows, _np, _v, _x, key): the current ranges in order, with their first keys."""

    spark: SparkSession
    path: str
    key: str
    field: str
    ascending: bool
    range_rows: int
    schema: T.StructType  # key, field, pos
    version: int
    lines: list[tuple]

    @property
    def rows(self) -> int:
        return sum(x[1] for x in self.lines)


def _directory_schema(key: T.DataType) -> T.StructType:
    fields = [("part", T.StringType()), ("rows", T.LongType()), ("_np", T.IntegerType()), ("_v", T.DoubleType()), ("_x", T.LongType())]
    return T.StructType([*(T.StructField(n, t) for n, t in fields), T.StructField("key", key)])


def _keyed(df: DataFrame, key: str, field: str, ascending: bool, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, field, *keep, *ORDER): descending order has NULL last, ascending order NULL first."""
    whole = isinstance(df.schema[field].dataType, T.IntegralType)
    exact = F.coalesce(F.col(field).cast("bigint") if whole else F.lit(0).cast("bigint"), F.lit(0))
    value = F.coalesce(F.col(field).cast("double"), F.lit(0.0))
    return df.select(
        key,
        field,
        *keep,
        F.when(F.col(field).isNull(), F.lit(0 if ascending else 2)).otherwise(F.lit(1)).alias("_np"),
        (value if ascending else -value).alias("_v"),
        (exact if ascending else F.bitwise_not(exact)).alias("_x"),
    )


def _write(store: RankStore, segmented: DataFrame) -> list[tuple]:
    """Number ``segmented`` (key, field, *ORDER, slot) inside its slots, cut the slots that grew into ranges, write
    them and return their directory lines in order. A slot's number is its place in the order."""
    numbered = cut_lineage(segmented_row_number(segmented, ["slot"], [*ORDER, store.key], "_n"))
    sizes = {r.slot: r.n for r in numbered.groupBy("slot").agg(F.count(F.lit(1)).alias("n")).collect()}
    pieces, per = {}, {}
    for slot, n in sizes.items():
        pieces[slot] = 1 if n <= 2 * store.range_rows else math.ceil(n / store.range_rows)
        per[slot] = math.ceil(n / pieces[slot])
    named = [(slot, i, new_part(f"{slot}.{i}"), per[slot]) for slot in sorted(sizes) for i in range(pieces[slot])]
    names = store.spark.createDataFrame(named, "slot int, piece int, part string, per long")
    widths = names.select("slot", "per").distinct()
    placed = (
        numbered.join(F.broadcast(widths), "slot")  # one line per touched range
        .withColumn("piece", F.expr("(_n - 1) div per").cast("int"))
        .withColumn("pos", F.expr("(_n - 1) % per + 1").cast("bigint"))
        .join(F.broadcast(names.select("slot", "piece", "part")), ["slot", "piece"])
    )
    first = placed.where("pos = 1").select("part", *ORDER, F.col(store.key).alias("key"))
    write_parts(placed.select(store.key, store.field, "pos", "part").repartition("part"), store.path)
    lows = {r.part: r for r in first.collect()}  # one row a range
    out = []
    for slot, i, part, width in named:
        r = lows[part]
        out.append((part, min(width, sizes[slot] - i * width), r._np, r._v, r._x, r.key))
    return out


def build_ranks(
    df: DataFrame, path: str, field: str, ascending: bool = False, key: str = "paper_id", range_rows: int = RANGE_ROWS
) -> RankStore:
    """Store ``df`` (key, field) in ranges of about ``range_rows`` rows under ``path``. Keys are unique."""
    spark = df.sparkSession
    schema = T.StructType([df.schema[key], df.schema[field], T.StructField("pos", T.LongType())])
    store = RankStore(spark, path, key, field, ascending, range_rows, schema, 1, [])
    rows = _keyed(df, key, field, ascending).withColumn("slot", F.lit(0))
    store.lines = _write(store, rows)
    write_directory(spark, path, store.lines, _directory_schema(df.schema[key].dataType), 1)
    return store


def open_ranks(
    spark: SparkSession, path: str, schema: T.StructType, ascending: bool = False, range_rows: int = RANGE_ROWS, version: int | None = None
) -> RankStore:
    """A stored version (the newest if none is named); ``schema`` holds the key and the field."""
    key, field = schema.fields[0], schema.fields[1]
    version, lines = read_directory(spark, path, _directory_schema(key.dataType), version)
    full = T.StructType([key, field, T.StructField("pos", T.LongType())])
    lines = sorted((tuple(r)[:6] for r in lines), key=lambda x: x[2:])
    return RankStore(spark, path, key.name, field.name, ascending, range_rows, full, version, lines)


def _slots(rows: DataFrame, lines: list[tuple], key: str) -> DataFrame:
    """``rows`` (key, field, *ORDER) with the number of the range that each falls into."""
    lows = [x[2:] for x in lines]  # one key a range

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = zip(*(b.column(c).to_pylist() for c in (*ORDER, key)), strict=True)
            slot = [max(0, bisect_right(lows, k) - 1) for k in keys]
            yield b.append_column("slot", pa.array(slot, pa.int32()))

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("slot", T.IntegerType())]))


def insert_ranks(store: RankStore, delta: DataFrame) -> RankStore:
    """The next version, with the rows of ``delta`` (key, field) added; their keys are not stored yet."""
    rows = _keyed(delta, store.key, store.field, store.ascending)
    if not store.lines:
        fresh = cut_lineage(rows.withColumn("slot", F.lit(0)))
        touched = [0] if fresh.limit(1).count() else []
    else:
        fresh = cut_lineage(_slots(rows, store.lines, store.key))
        touched = sorted(r.slot for r in fresh.select("slot").distinct().collect())  # at most the ranges
    if not touched:
        return store
    if store.lines:
        old = {store.lines[s][0]: s for s in touched}
        names = store.spark.createDataFrame(list(old.items()), "part string, slot int")
        held = read_parts(store.spark, store.path, store.schema, list(old)).join(F.broadcast(names), "part")
        fresh = _keyed(held, store.key, store.field, store.ascending, ("slot",)).unionByName(fresh)
    lines = _write(store, fresh)
    kept = [x for s, x in enumerate(store.lines) if s not in set(touched)]
    lines = sorted([*kept, *lines], key=lambda x: x[2:])
    schema = _directory_schema(store.schema[store.key].dataType)
    write_directory(store.spark, store.path, lines, schema, store.version + 1)
    return RankStore(
        store.spark, store.path, store.key, store.field, store.ascending, store.range_rows, store.schema, store.version + 1, lines
    )


def _offsets(store: RankStore) -> list[int]:
    return [0, *accumulate(x[1] for x in store.lines)]


def _ranked(store: RankStore, at: list[int]) -> DataFrame:
    offsets = _offsets(store)
    named = [(store.lines[i][0], offsets[i]) for i in at]
    names = store.spark.createDataFrame(named, "part string, offset long")
    rows = read_parts(store.spark, store.path, store.schema, [x[0] for x in named])
    joined = rows.join(F.broadcast(names), "part")  # one line a range
    return joined.select(store.key, store.field, (F.col("offset") + F.col("pos")).alias("rank"))


def ranks(store: RankStore) -> DataFrame:
    """(key, field, rank) of every row."""
    return _ranked(store, list(range(len(store.lines))))


def page(store: RankStore, offset: int, n: int) -> DataFrame:
    """(key, field, rank): the ``n`` rows after the first ``offset`` (T2, T4), from the ranges that hold them."""
    offsets = _offsets(store)
    at = [i for i in range(len(store.lines)) if offsets[i] < offset + n and offsets[i + 1] > offset]
    return _ranked(store, at).where((F.col("rank") > offset) & (F.col("rank") <= offset + n)).orderBy("rank")
