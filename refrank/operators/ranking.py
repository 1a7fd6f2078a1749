"""Exact global ranks and top-k without a single-partition window.

``row_number() over (order by k)`` with no PARTITION BY plans ``Exchange SinglePartition``: every
row goes through one task. ``global_row_number`` gives the same numbers distributed:

1. range-partition on the full sort key (the key plus a unique tie-break column, so even a value
   shared by a third of the rows is split across ranges by the tie-break),
2. sort inside each range and tag rows with ``monotonically_increasing_id`` (partition index in the
   high bits, position in the low bits),
3. checkpoint into the shared folder so the range bounds, counts and positions all come from one
   materialisation (a recomputed partition cannot move rows between ranges),
4. count rows per range (one row per range), prefix-sum those counts (tiny) and add the offset.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from refrank.session import cut_lineage

_LOW_BITS = (1 << 33) - 1


def _order_expr(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def global_row_number(
    df: DataFrame,
    order: Sequence[Column | str],
    name: str = "row_number",
    num_ranges: int | None = None,
) -> DataFrame:
    """Add ``name`` = 1-based position of each row under ``order`` (which must be a total order,
    i.e. end in a unique column). Equal to ``row_number().over(Window.orderBy(*order))``."""
    order = [_order_expr(c) for c in order]
    ranged = df.repartitionByRange(num_ranges, *order) if num_ranges else df.repartitionByRange(*order)
    tagged = cut_lineage(
        ranged.sortWithinPartitions(*order).withColumn("_rr_tag", F.monotonically_increasing_id())
    )
    rng = F.shiftright("_rr_tag", 33)
    sizes = tagged.groupBy(rng.alias("_rr_range")).agg(F.count(F.lit(1)).alias("_rr_size"))
    # One row per range: the prefix sum runs over a table bounded by the number of ranges.
    before = Window.orderBy("_rr_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_rr_range", F.coalesce(F.sum("_rr_size").over(before), F.lit(0)).alias("_rr_offset"))
    return (
        tagged.withColumn("_rr_range", rng)
        .join(F.broadcast(offsets), "_rr_range")
        .withColumn(name, F.col("_rr_offset") + F.col("_rr_tag").bitwiseAND(F.lit(_LOW_BITS)) + 1)
        .drop("_rr_range", "_rr_offset", "_rr_tag")
    )


def single_partition_row_number(df: DataFrame, order: Sequence[Column | str], name: str) -> DataFrame:
    """The naive form (one task sees every row); kept for tests and the bench comparison."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*[_order_expr(c) for c in order])))


def top_k(df: DataFrame, order: Sequence[Column | str], k: int) -> DataFrame:
    """``ORDER BY … LIMIT k``: planned as TakeOrderedAndProject (per-task top-k, then merge)."""
    return df.orderBy(*[_order_expr(c) for c in order]).limit(k)


def top_k_per_group(
    df: DataFrame, group: Sequence[str], order: Sequence[Column | str], k: int, name: str = "rn"
) -> DataFrame:
    """Top-k rows inside each group. Callers pre-reduce groups (local top-k per block) first, so a
    group never holds more than k times the number of blocks rows."""
    w = Window.partitionBy(*group).orderBy(*[_order_expr(c) for c in order])
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def running_count(
    df: DataFrame,
    segment: Sequence[str],
    order: Sequence[Column | str],
    flag: Column,
    name: str,
) -> DataFrame:
    """Add ``name`` = number of rows of the same segment that come strictly before this row under
    ``order`` (a total order inside the segment) and have ``flag`` true.

    A segmented, distributed prefix sum: range-partition on (segment, order) so a segment holding a
    third of the rows is split over many ranges; exclusive running sums inside each (range,
    segment); per-(range, segment) totals (one row each) prefix-summed across ranges per segment.
    """
    keys = [F.col(s) for s in segment] + [_order_expr(c) for c in order]
    tagged = cut_lineage(
        df.withColumn("_rc_f", flag.cast("long"))
        .repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_rc_tag", F.monotonically_increasing_id())
    ).withColumn("_rc_rng", F.shiftright("_rc_tag", 33))
    local_w = Window.partitionBy("_rc_rng", *segment).orderBy("_rc_tag").rowsBetween(Window.unboundedPreceding, -1)
    local = tagged.withColumn("_rc_local", F.coalesce(F.sum("_rc_f").over(local_w), F.lit(0)))
    totals = tagged.groupBy("_rc_rng", *segment).agg(F.sum("_rc_f").alias("_rc_tot"))
    prev_w = Window.partitionBy(*segment).orderBy("_rc_rng").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_rc_rng", *segment, F.coalesce(F.sum("_rc_tot").over(prev_w), F.lit(0)).alias("_rc_off"))
    return (
        local.join(offsets, ["_rc_rng", *segment])
        .withColumn(name, F.col("_rc_off") + F.col("_rc_local"))
        .drop("_rc_f", "_rc_tag", "_rc_rng", "_rc_local", "_rc_off")
    )


def global_row_numbers(
    df: DataFrame, key: str, ranks: Sequence[tuple[str, str, bool]]
) -> DataFrame:
    """Several independent exact global row numbers in one distributed pass.

    ``ranks`` = [(name, numeric column, descending)]; each is ``row_number() over (order by column
    [desc nulls last | asc nulls first], key)``. The rankings are stacked into one long table
    (rank index, signed value, key) and numbered by one segmented row number — one range shuffle
    and one checkpoint instead of one per ranking — then pivoted back to one row per key.
    Values are compared as doubles, then integers of one double exactly.
    """
    stacked = None
    for i, (name, col, desc) in enumerate(ranks):
        v = F.col(col).cast("double")
        whole = isinstance(df.schema[col].dataType, T.IntegralType)
        exact = F.col(col).cast("bigint") if whole else F.lit(0).cast("bigint")
        part = df.select(
            F.col(key),
            F.lit(i).alias("_gr_i"),
            # desc nulls last == (-v) asc nulls last; asc nulls first keeps v with nulls first.
            (-v if desc else v).alias("_gr_v"),
            # ~x = -x - 1 turns the order round without overflow
            (F.bitwise_not(exact) if desc else exact).alias("_gr_x"),
            F.lit(not desc).alias("_gr_nulls_first"),
        )
        stacked = part if stacked is None else stacked.unionByName(part)
    # NULL placement per ranking: a flag column that sorts before/after every value.
    null_pos = F.when(F.col("_gr_v").isNull(), F.when(F.col("_gr_nulls_first"), F.lit(0)).otherwise(F.lit(2))).otherwise(
        F.lit(1)
    )
    numbered = segmented_row_number(
        stacked.withColumn("_gr_np", null_pos),
        ["_gr_i"],
        [F.col("_gr_np").asc(), F.col("_gr_v").asc(), F.col("_gr_x").asc(), F.col(key).asc()],
        "_gr_rn",
    )
    wide = numbered.groupBy(key).pivot("_gr_i", list(range(len(ranks)))).agg(F.first("_gr_rn"))
    return df.join(wide.select(key, *[F.col(str(i)).alias(name) for i, (name, _, _) in enumerate(ranks)]), key)


def segmented_row_number(
    df: DataFrame, segment: Sequence[str], order: Sequence[Column | str], name: str
) -> DataFrame:
    """``row_number() over (partition by segment order by order)``, distributed and skew-safe, for a
    *small number of segments* (e.g. the stacked rankings).

    Ranges come from one range shuffle on (segment, order); inside a range a segment's rows are
    contiguous, so a row's position is its tag minus the smallest tag of its (range, segment). The
    per-(range, segment) table has at most ranges + segments rows: prefix-summed and broadcast.
    """
    keys = [F.col(s) for s in segment] + [_order_expr(c) for c in order]
    tagged = cut_lineage(
        df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_sr_tag", F.monotonically_increasing_id())
    ).withColumn("_sr_rng", F.shiftright("_sr_tag", 33))
    groups = tagged.groupBy("_sr_rng", *segment).agg(
        F.count(F.lit(1)).alias("_sr_n"), F.min("_sr_tag").alias("_sr_first")
    )
    before = Window.partitionBy(*segment).orderBy("_sr_rng").rowsBetween(Window.unboundedPreceding, -1)
    offsets = groups.select(
        "_sr_rng", *segment, "_sr_first", F.coalesce(F.sum("_sr_n").over(before), F.lit(0)).alias("_sr_off")
    )
    return (
        tagged.join(F.broadcast(offsets), ["_sr_rng", *segment])
        .withColumn(name, F.col("_sr_off") + (F.col("_sr_tag") - F.col("_sr_first")) + 1)
        .drop("_sr_tag", "_sr_rng", "_sr_first", "_sr_off")
    )
