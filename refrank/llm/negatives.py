"""Hard-negative mining over a GNAT-style multiway hyperplane tree.

A node of the tree has up to ``WAYS`` split points; every row goes to the child of its nearest one. For each
ordered pair (split point i, child j) the tree stores the range of distances from point i to *all* rows
below child j, and the range of their squared norms. Rows are integer vectors, so for a query q of known norm
the window ``low <= q.x <= high`` is an annulus around q: ``|x - q|^2 = |q|^2 + |x|^2 - 2 q.x``. A child is
eliminated when, for some split point, the distances to q that its range allows miss the annuli of all windows
of the query. What is left is scored exactly, leaf by leaf.

The points are fitted on a bounded sample (``SAMPLE`` rows, the first by hash), every row is indexed, and the
ranges are minima and maxima over all rows, so the search loses nothing whatever the sample was. A leaf is
stored in cells of at most about ``CELL_ROWS`` rows, and anchors travel in blocks of about ``ANCHOR_BLOCK``;
a task holds one cell and one block. Queries first look into one cell of their own leaf: the k-th score found
there raises the lower edge of the window for the full search.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refrank.llm.base import materialise

SAMPLE = 8192  # rows the split points are chosen from
WAYS = 16
LEAF_SAMPLE = 64  # sample rows in a leaf, at most
LEAF_ROWS = 4096  # rows in a leaf the tree aims at; it has at most SAMPLE / LEAF_SAMPLE * 2 leaves or so
CELL_ROWS = 32_768
ANCHOR_BLOCK = 8192
SCORES = 1 << 21  # scores held at a time in a task
EXACT = float(1 << 53)


@dataclass
class Tree:
    """``points[k]`` are the split points of node k; ``children[k][j]`` is a node, or -1 - leaf."""

    points: list[np.ndarray]
    children: list[list[int]]
    leaves: int


def _squares(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Squared distances, exact for integers below 2^53."""
    return (x * x).sum(1)[:, None] - 2.0 * (x @ points.T) + (points * points).sum(1)[None, :]


def fit_tree(sample: np.ndarray, leaf_sample: int, ways: int = WAYS) -> Tree:
    """Split points are chosen farthest first; a node whose rows are all equal is a leaf."""
    tree = Tree([], [], 0)

    def grow(rows: np.ndarray) -> int:
        if len(rows) > leaf_sample:
            picked, far = [0], _squares(rows, rows[:1])[:, 0]
            while len(picked) < ways and far.max() > 0:
                picked.append(int(far.argmax()))
                far = np.minimum(far, _squares(rows, rows[picked[-1:]])[:, 0])
            if len(picked) > 1:
                k = len(tree.points)
                tree.points.append(rows[picked])
                tree.children.append([])
                child = _squares(rows, rows[picked]).argmin(1)
                tree.children[k] = [grow(rows[child == j]) for j in range(len(picked))]
                return k
        tree.leaves += 1
        return -tree.leaves

    root = grow(sample)
    if root < 0:  # one leaf: a node with a single way
        tree.points.append(sample[:1])
        tree.children.append([root])
    return tree


def descend(tree: Tree, x: np.ndarray):
    """Yield (node, rows, squared distances to its points, child of each row) for every node that is reached."""
    todo = [(0, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        if not len(rows):
            continue
        squares = _squares(x[rows], tree.points[node])
        child = squares.argmin(1)
        yield node, rows, squares, child
        for j, to in enumerate(tree.children[node]):
            if to >= 0:
                todo.append((to, rows[child == j]))


def leaf_of(tree: Tree, x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), np.int32)
    for node, rows, _, child in descend(tree, x):
        to = np.array(tree.children[node])[child]
        out[rows[to < 0]] = -1 - to[to < 0]
    return out


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def ranges(indexed: DataFrame, tree: Tree, dim: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """node -> (low, high), each (points + 1, children): distance ranges; the last line is of squared norms.

    Each partition reduces its rows to one line per (point, child); what reaches the driver is bounded by
    the tree, not by the rows."""

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int, int], list[float]] = {}
        for b in batches:
            x = _matrix(b.column(0), dim)
            norms = (x * x).sum(1)
            for node, rows, squares, child in descend(tree, x):
                far = np.sqrt(np.maximum(squares, 0))
                for j in np.unique(child).tolist():
                    own = child == j
                    lines = np.vstack([far[own].T, norms[rows[own]][None, :]])
                    for i, (low, high) in enumerate(zip(lines.min(1).tolist(), lines.max(1).tolist(), strict=True)):
                        old = found.get((node, i, j), [low, high])
                        found[node, i, j] = [min(old[0], low), max(old[1], high)]
        keys = list(found)
        yield pa.RecordBatch.from_pydict(
            {
                "node": pa.array([k[0] for k in keys], pa.int32()),
                "i": pa.array([k[1] for k in keys], pa.int32()),
                "j": pa.array([k[2] for k in keys], pa.int32()),
                "low": pa.array([found[k][0] for k in keys], pa.float64()),
                "high": pa.array([found[k][1] for k in keys], pa.float64()),
            }
        )

    out = {}
    for k, points in enumerate(tree.points):  # a child without rows keeps an empty range and is never searched
        shape = (len(points) + 1, len(tree.children[k]))
        out[k] = (np.full(shape, np.inf), np.full(shape, -np.inf))
    lines = indexed.select("q").mapInArrow(reduce, "node int, i int, j int, low double, high double")
    for r in lines.groupBy("node", "i", "j").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():
        out[r.node][0][r.i, r.j], out[r.node][1][r.i, r.j] = r.low, r.high
    return out


def surviving_leaves(
    tree: Tree, spans: dict, x: np.ndarray, low: np.ndarray, high: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """(query, leaf) pairs left after elimination; ``low``, ``high`` (queries, windows) bound the scores."""
    norms, found = (x * x).sum(1), []
    todo = [(0, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        lo, hi = spans[node]
        d = np.sqrt(np.maximum(_squares(x[rows], tree.points[node]), 0))[:, :, None]
        nearest = np.maximum(d - hi[None, :-1], lo[None, :-1] - d).max(1)  # of any row below child j
        farthest = (d + hi[None, :-1]).min(1)
        least = norms[rows, None, None] + lo[-1][None, :, None] - 2.0 * high[rows][:, None, :]
        most = norms[rows, None, None] + hi[-1][None, :, None] - 2.0 * low[rows][:, None, :]
        slack = 1e-6 * (1.0 + np.abs(d).max(initial=0.0))  # square roots are rounded
        inner, outer = np.sqrt(np.maximum(least, 0)) - slack, np.sqrt(np.maximum(most, 0)) + slack
        empty = (most < 0) | ~np.isfinite(lo[-1])[None, :, None] | (low > high)[rows][:, None, :]
        live = (~empty & (outer >= nearest[:, :, None]) & (inner <= farthest[:, :, None])).any(2)
        for j, to in enumerate(tree.children[node]):
            left = rows[live[:, j]]
            if len(left):
                if to >= 0:
                    todo.append((to, left))
                else:
                    found.append((left, np.full(len(left), -1 - to, np.int32)))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int32)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


@dataclass
class Index:
    rows: DataFrame  # (cell, vec_id, label, q): all that can be found
    tree: Tree
    spans: dict
    cells: np.ndarray  # of each leaf
    dim: int


QUERY = "cell long, block int, row long, anchor_id long, label int, q array<double>, w array<int>, low array<double>, high array<double>"


def build_index(rows: DataFrame, dim: int, total: int) -> Index:
    """Index every row of ``rows`` (vec_id, label, q of length ``dim``); ``total`` is their number."""
    spot = F.xxhash64("vec_id", "label")
    share = F.pmod(spot, F.lit(1 << 20)) < 1 + (SAMPLE << 22) // max(1, total)  # about 4 * SAMPLE rows are ordered
    sample = rows.where(share).orderBy(spot, "vec_id").limit(SAMPLE).select("q").toPandas()
    points = np.array(sample["q"].tolist() or [[0.0] * dim], np.float64).reshape(-1, dim)
    leaf_sample = max(LEAF_SAMPLE, len(points) * LEAF_ROWS // max(1, total))
    tree = fit_tree(points, leaf_sample)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield b.append_column("leaf", pa.array(leaf_of(tree, _matrix(b.column("q"), dim))))

    placed = materialise(
        rows.select("vec_id", "label", "q").mapInArrow(place, "vec_id long, label int, q array<double>, leaf int")
    )
    cells = np.ones(tree.leaves, np.int64)
    for r in placed.groupBy("leaf").count().collect():  # one line a leaf
        cells[r.leaf] = -(-r["count"] // CELL_ROWS)
    chunk = F.pmod(F.xxhash64("vec_id"), F.element_at(F.array(*[F.lit(int(c)) for c in cells]), F.col("leaf") + 1))
    cell = (F.col("leaf").cast("bigint") * (1 << 32) + chunk).alias("cell")
    return Index(placed.select(cell, "vec_id", "label", "q"), tree, ranges(placed, tree, dim), cells, dim)


def _routed(index: Index, queries: DataFrame, blocks: int, home: bool) -> DataFrame:
    """``queries`` once for every cell they must visit; ``home`` sends each to one cell of its own leaf."""
    tree, spans, cells, dim = index.tree, index.spans, index.cells, index.dim

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                x = _matrix(b.column("q"), dim)
                row = b.column("row").to_numpy()
                if home:
                    who, leaf = np.arange(len(x)), leaf_of(tree, x).astype(np.int64)
                    chunk = row % cells[leaf]
                else:
                    width = np.diff(b.column("low").offsets.to_numpy())
                    low, high = np.full((len(x), int(width.max())), np.inf), np.full((len(x), int(width.max())), -np.inf)
                    inside = np.arange(low.shape[1])[None, :] < width[:, None]
                    low[inside], high[inside] = b.column("low").flatten().to_numpy(), b.column("high").flatten().to_numpy()
                    who, leaf = surviving_leaves(tree, spans, x, low, high)
                    times = cells[leaf]
                    who, leaf = np.repeat(who, times), np.repeat(leaf.astype(np.int64), times)
                    chunk = np.arange(len(who)) - np.repeat(np.cumsum(times) - times, times)
                if not len(who):
                    continue
                out = b.take(pa.array(who))
                block = pa.array((row[who] % blocks).astype(np.int32))
                out = out.add_column(0, "block", block).add_column(0, "cell", pa.array(leaf * (1 << 32) + chunk))
                yield from pa.Table.from_batches([out]).to_batches(max_chunksize=4096)

    return queries.select("row", "anchor_id", "label", "q", "w", "low", "high").mapInArrow(route, QUERY)


def _first(index: Index, routed: DataFrame, blocks: int, k: int, same: bool) -> DataFrame:
    """(row, w, vec_id, score): the k first rows of each window in each cell that a query visits."""
    dim = index.dim

    def score(cell: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if cell.num_rows and asked.num_rows:
            cell, asked = cell.combine_chunks(), asked.combine_chunks()
            ids, labels = cell["vec_id"].to_numpy(), cell["label"].to_numpy()
            x, q = _matrix(cell["q"].chunk(0), dim), _matrix(asked["q"].chunk(0), dim)
            own, label, row = (asked[c].to_numpy() for c in ("anchor_id", "label", "row"))
            w, low, high = (asked[c].to_pylist() for c in ("w", "low", "high"))
            step = max(1, SCORES // len(x))
            for at in range(0, len(q), step):
                scores = q[at : at + step] @ x.T
                for a, line in enumerate(scores, at):
                    allowed = (labels == label[a]) == same
                    allowed &= ids != own[a]
                    for n, lo, hi in zip(w[a], low[a], high[a], strict=True):
                        hit = np.flatnonzero(allowed & (line >= lo) & (line <= hi))
                        if len(hit) > k:
                            hit = hit[line[hit] >= np.partition(line[hit], -k)[-k]]
                        hit = hit[np.lexsort((ids[hit], -line[hit]))[:k]]
                        out.append((np.full(len(hit), row[a]), np.full(len(hit), n, np.int32), ids[hit], line[hit].astype(np.int64)))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [[], [], [], []]
        types = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
        return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["row", "w", "vec_id", "score"])

    rows = index.rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return (
        rows.groupBy("cell", "block")
        .cogroup(routed.groupBy("cell", "block"))
        .applyInArrow(score, "row long, w int, vec_id long, score long")
    )


def window_search(index: Index, queries: DataFrame, anchors: int, k: int, same: bool) -> DataFrame:
    """(row, w, rank, vec_id, score): the ``k`` highest scores inside each window, ties by smaller vec_id.

    ``queries`` (row, anchor_id, label, q, w, low, high) has one window per entry of its arrays; rows of the
    same label are searched if ``same``, else rows of all others; a query's own vec_id is left out."""
    blocks = -(-max(1, anchors) // ANCHOR_BLOCK)
    seeds = _first(index, _routed(index, queries, blocks, home=True), blocks, k, same)
    edges = seeds.groupBy("row", "w").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("edge")).where(F.col("n") >= k)
    edges = edges.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("w", "edge"))).alias("edges"))
    raised = queries.join(edges, "row", "left").withColumn(
        "low",
        F.when(F.col("edges").isNull(), F.col("low")).otherwise(
            F.zip_with("w", "low", lambda w, low: F.greatest(low, F.element_at("edges", w).cast("double")))
        ),
    )
    found = _first(index, _routed(index, raised, blocks, home=False), blocks, k, same)
    best = Window.partitionBy("row", "w").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("row", "w", "rank", "vec_id", "score")


def integer_vectors(rows: DataFrame, scale: float) -> DataFrame:
    """(vec_id, label, q, anchor): each component x as floor(scale * x); rows that take no part are left out."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return rows.select(
        F.col("vec_id").cast("bigint").alias("vec_id"),
        F.col("label").cast("int").alias("label"),
        F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v).cast("double")).alias("q"),
        F.col("anchor").alias("anchor"),
        finite.alias("finite"),
    ).where("vec_id is not null and label is not null and finite").drop("finite")


def hard_negatives(
    rows: DataFrame,
    anchor: Column,
    positives: int = 5,
    negatives: int = 5,
    low_percent: int = 80,
    high_percent: int = 100,
    scale: float = 256.0,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows that hold ``anchor``.

    ``rows`` has vec_id, label, embedding. A score is the integer inner product of the scaled, floored
    vectors. The positives of an anchor are its first other rows of the same label; the negatives of a
    positive are the first rows of other labels whose score lies from ``low_percent`` to ``high_percent`` of the
    positive's. Higher scores come first, ties by smaller vec_id.

    Rows with a NULL vec_id, label, vector or component, or with a component that is not finite, take no part.
    Equal rows count once; rows that share a vec_id but not label or vector are rows of their own. A shorter
    vector is read as if zeros followed. No row left: an empty result. Other columns are ignored. Scores must
    be exact in doubles: components so large that a product could reach 2^53 raise a ValueError.

    Of the rows with one label and one vector only the first ``max(positives + 1, negatives)`` by vec_id can
    ever be returned (they tie on every score), so only those are searched: a third of the table may be
    copies of one vector without a quadratic search. Every one of them still counts as an anchor."""
    spark = rows.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    part = integer_vectors(rows.withColumn("anchor", F.coalesce(anchor, F.lit(False))), scale)
    part = part.groupBy("vec_id", "label", "q").agg(F.max("anchor").alias("anchor"))
    part = materialise(part.withColumn("row", F.monotonically_increasing_id()))
    seen = part.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("anchor").alias("anchors"),
        F.max(F.size("q")).alias("dim"),
        F.max(F.array_max(F.transform("q", lambda v: F.abs(v)))).alias("most"),
    ).first()
    if not seen.anchors:
        return spark.createDataFrame([], schema)
    dim = max(1, seen.dim)
    if dim * (seen.most or 0.0) ** 2 >= EXACT:
        raise ValueError("components are too large for exact scores")
    part = part.withColumn("q", F.concat("q", F.array_repeat(F.lit(0.0), F.lit(dim) - F.size("q"))))
    copies = Window.partitionBy(F.xxhash64("q"), "label", "q").orderBy("vec_id")
    reach = max(positives + 1, negatives)
    index = build_index(part.withColumn("nth", F.row_number().over(copies)).where(F.col("nth") <= reach), dim, seen.n)

    anchors = part.where("anchor").withColumnRenamed("vec_id", "anchor_id")
    inf = float("inf")
    queries = anchors.select(
        "row", "anchor_id", "label", "q",
        F.array(F.lit(1)).alias("w"), F.array(F.lit(-inf)).alias("low"), F.array(F.lit(inf)).alias("high"),
    )
    found = window_search(index, queries, seen.anchors, positives, same=True)
    found = materialise(found.select("row", F.col("rank").alias("w"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    at_least, at_most = f"positive_score * {low_percent}", f"positive_score * {high_percent}"
    low = F.expr(f"({at_least} + pmod(-({at_least}), 100)) div 100").cast("double").alias("low")
    high = F.expr(f"({at_most} - pmod({at_most}, 100)) div 100").cast("double").alias("high")
    windows = (
        found.select("row", F.struct("w", low, high).alias("window"))
        .where("window.low <= window.high")
        .groupBy("row")
        .agg(F.collect_list("window").alias("windows"))  # at most ``positives``
    )
    asked = anchors.join(windows, "row").select(
        "row", "anchor_id", "label", "q", F.col("windows.w").alias("w"), F.col("windows.low").alias("low"), F.col("windows.high").alias("high")
    )
    negative = window_search(index, asked, seen.anchors, negatives, same=False)
    return (
        negative.join(found, ["row", "w"])
        .join(anchors.select("row", "anchor_id"), "row")
        .select(
            "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
            "positive_score", F.col("score").alias("negative_score"),
        )
    )
