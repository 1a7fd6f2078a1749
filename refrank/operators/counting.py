"""The weighted model for all authors (R2) by counting ranks, at any corpus size.

A score needs the rank of every candidate among all candidates of its author, but no pair has to leave
the (author row, paper rows) cell it is computed in. Authors, each with the known papers, and papers are packed and
written once, and Spark's Cartesian product reads the pairs of them (``operators.packed``): no block is
replicated through a shuffle. Three passes over the same cells:

1. **Histograms.** Every cell counts its similarities per author in a fixed grid, and the static ranks
   of the author's known papers in another. Summed over cells they are at most ``BINS`` counts per
   author and field, whatever the corpus.
2. **Bounds.** With the summed histograms a cell knows each pair's cosine rank up to the papers in the
   same bin, and each static rank up to the known papers in the same bin: a lower and an upper bound of
   its score, for weights of any sign. A pair whose lower bound lies above the k-th best upper bound of
   its author cannot be among the k best; the others survive, k and a few per author as a rule. A cell takes its
   papers by the static part of the score and stops where that part alone lies above the bound.
3. **Exact ranks.** Survivors go back to all cells of their author; every cell counts the candidates
   ahead of them and the known papers with a smaller static rank, and the counts add up.

Passes 1 and 3 see all pairs, in float32. Pass 1 widens the bins of pass 2 by what that may be off; pass 3 computes
again, in float64 and rounded to twelve places, the pairs too close to a survivor to tell which is ahead. Cells
are worked through in tiles; an author's known papers are one list of candidates, each once. How many
pairs survive depends on how finely the grid parts the similarities; the result does not, and an author whose
candidates all share one similarity keeps all pairs that their static ranks cannot rule out.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from refrank.functions.vectors import linear_score
from refrank.operators.packed import NONE, PACK, PACKS, WIDTH, Row, author_parts, below, block_of, error, exact, flat, numbered, over_pairs, pack, pairs, place, with_known
from refrank.operators.ranking import top_k_per_group
from refrank.session import cut_lineage

BINS = 256
AUTHOR_BLOCK = 1024
PAPER_BLOCK = 16384
TILE = (512, 1024)  # authors and papers whose similarities are held at a time
ROWS = 128  # authors of them that are looked at together
CHUNK = (256, 512)  # the same in pass 2
PLACES = 12
SCALE = (BINS - 1) / 2
BIN_ERROR = 2.0**-15  # a bin is found in float32, next to the number of its row in the tile
VECTOR, KNOWN, SURVIVOR = 0, 1, 2

Kernel = Callable[..., pd.DataFrame]


@dataclass
class Cell:
    """Authors and papers, both by id, that meet in a task; ``known`` are the positions (author, paper) of known pairs by
    paper, ``counts`` the histograms of pass 1, ``found`` the survivors of pass 2."""

    authors: np.ndarray
    papers: np.ndarray
    vectors: np.ndarray
    matrix: np.ndarray
    known: tuple[np.ndarray, np.ndarray]
    static: dict[str, np.ndarray]
    counts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)  # (author, code, n)
    found: pd.DataFrame | None = None
    block: int = WIDTH
    single: np.ndarray | None = None  # ``matrix`` in float32

    def __post_init__(self):
        if self.single is None:
            self.single = self.matrix.astype(np.float32)

    def tiles(self, scale: float = 1.0) -> Iterator[tuple]:
        """(first author, first paper, similarities times ``scale`` in float32, known pairs in it), tile by tile; products
        of at most ``block`` papers at a time."""
        left, right = (self.vectors * scale).astype(np.float32), self.single
        held, width = np.empty(TILE[0] * TILE[1], np.float32), min(self.block, WIDTH)
        who, paper = self.known
        for c in range(0, len(right), TILE[1]):
            stop = min(c + TILE[1], len(right))
            here = slice(*np.searchsorted(paper, [c, stop]))
            by = np.argsort(who[here], kind="stable")
            k_who, k_paper = who[here][by], paper[here][by] - c
            for first in range(0, len(left), TILE[0]):
                some = left[first : first + TILE[0]]
                sims = held[: len(some) * (stop - c)].reshape(len(some), stop - c)
                for p in range(c, stop, width):
                    last = min(p + width, stop)
                    np.matmul(some, right[p:last].T, out=sims[:, p - c : last - c])
                for at in range(first, first + len(some), ROWS):
                    rows = sims[at - first : at - first + ROWS]
                    mine = slice(*np.searchsorted(k_who, [at, at + len(rows)]))
                    yield at, c, rows, (k_who[mine] - at, k_paper[mine])


def _cell(left: pd.DataFrame, right: pd.DataFrame, static: Sequence[str]) -> Cell:
    """The cell of frames: ``left`` holds authors (with ``codes`` and ``counts`` in pass 2), known pairs and survivors."""
    authors = left[left["_kind"] == VECTOR].sort_values("author_id")
    papers = right.sort_values("paper_id")
    known = left[left["_kind"] == KNOWN]
    a = pd.Index(authors["author_id"]).get_indexer(known["author_id"])
    p = pd.Index(papers["paper_id"]).get_indexer(known["paper_id"])
    a, p = a[(a >= 0) & (p >= 0)], p[(a >= 0) & (p >= 0)]
    by = np.argsort(p, kind="stable")
    a_ids, p_ids = authors["author_id"].to_numpy(), papers["paper_id"].to_numpy()
    vectors, matrix = (np.stack(x["embedding"].to_numpy()) if len(x) else np.zeros((0, 1)) for x in (authors, papers))
    cell = Cell(a_ids, p_ids, vectors, matrix, (a[by], p[by]), {c: papers[c].to_numpy().astype(np.int64) for c in static})
    if "codes" in authors:
        lists = [(i, x, n) for i, (x, n) in enumerate(zip(authors["codes"], authors["counts"], strict=True)) if isinstance(x, list)]
        cell.counts = [(np.full(len(x), i), np.asarray(x, np.int64), np.asarray(n, np.int64)) for i, x, n in lists]
    found = left[left["_kind"] == SURVIVOR]
    if len(found):
        cell.found = found.assign(at=pd.Index(a_ids).get_indexer(found["author_id"]))
    return cell


def _of(left, right, static: Sequence[str]) -> Cell:
    return left if isinstance(left, Cell) else _cell(left, right, static)


def _no_rows(columns: list[str]) -> pd.DataFrame:
    return pd.DataFrame({c: pd.Series([], dtype=object) for c in columns})


def _similarity_bin(sims: np.ndarray) -> np.ndarray:
    return np.clip(sims * SCALE + BINS / 2, 0, BINS - 1).astype(np.int64)


def _count(static: Sequence[str], width: int) -> Kernel:
    """Pass 1: (author_id, code, n); a code is field * BINS + bin, field 0 the similarity."""

    def run(key, left, right=None) -> pd.DataFrame:
        cell = _of(left, right, static)
        if not len(cell.authors) or not len(cell.papers):
            return _no_rows(["author_id", "code", "n"])
        held = np.zeros((len(cell.authors), BINS), np.int64)
        first = (np.arange(ROWS) * BINS + BINS / 2).astype(np.float32)[:, None]
        codes = np.empty(ROWS * TILE[1], np.int64)
        for at, _, sims, (a, p) in cell.tiles(SCALE):
            np.add(sims, first[: len(sims)], out=sims)
            flat_codes = codes[: sims.size]
            flat_codes[:] = sims.ravel()
            held[at : at + len(sims)] += np.bincount(flat_codes, minlength=len(sims) * BINS).reshape(len(sims), BINS)
            np.subtract.at(held[at : at + len(sims)].reshape(-1), flat_codes[a * sims.shape[1] + p], 1)
        who, code = np.nonzero(held)
        out = [(who, code, held[who, code])]
        a, p = cell.known
        for i, c in enumerate(static, 1):
            bins = (cell.static[c][p] - 1) // width
            found, n = np.unique(a * BINS + bins, return_counts=True)
            out.append((found // BINS, i * BINS + found % BINS, n))
        who, code, n = (np.concatenate(x) for x in zip(*out, strict=True))
        return pd.DataFrame({"author_id": cell.authors[who], "code": code.astype(np.int32), "n": n.astype(np.int64)})

    return run


def _bound(k: int, weights: Sequence[float], static: Sequence[str], width: int) -> Kernel:
    """Pass 2: (author_id, paper_id, similarity, low, high, static ranks) of the pairs that may be among the
    author's k best as far as this cell can tell."""

    def run(key, left, right=None) -> pd.DataFrame:
        cols = ["author_id", "paper_id", "similarity", "low", "high", *static]
        cell = _of(left, right, static)
        if not len(cell.authors) or not len(cell.papers):
            return _no_rows(cols)
        n_authors, n_papers = len(cell.authors), len(cell.papers)
        held = np.zeros((n_authors, 1 + len(static), BINS), np.int64)
        for who, code, n in cell.counts:
            np.add.at(held.reshape(n_authors, -1), (who, code), n)  # a code once a task of pass 1
        upto = np.cumsum(held, axis=2)
        ahead = upto[:, 0, -1:] - upto[:, 0]  # candidates in better bins
        off = error(cell.matrix.shape[1]) + BIN_ERROR
        ranks = [cell.static[c] for c in static]
        alone = sum((w * r for w, r in zip(weights[1:], ranks, strict=True)), np.zeros(n_papers))
        order = np.argsort(alone, kind="stable")
        alone = alone[order]
        # No score is below the static part plus this: the best cosine rank, and all known papers ahead.
        floor = weights[0] * (1 if weights[0] >= 0 else upto[:, 0, -1]) - sum(
            (w * upto[:, i, -1] for i, w in enumerate(weights[1:], 1) if w > 0), np.zeros(n_authors)
        )
        a, p = cell.known
        place_of = np.empty(n_papers, np.int64)
        place_of[order] = np.arange(n_papers)
        p = place_of[p]
        by = np.argsort(a, kind="stable")
        a, p = a[by], p[by]
        limit, tops, out = np.full(n_authors, np.inf), np.full((n_authors, k), np.inf), []
        for at in range(0, n_authors, CHUNK[0]):
            live = np.arange(at, min(at + CHUNK[0], n_authors))
            mine = slice(*np.searchsorted(a, [at, at + CHUNK[0]]))
            for c in range(0, n_papers, CHUNK[1]):
                live = live[floor[live] + alone[c] <= limit[live] + _slack(limit[live])]
                if not len(live):
                    break
                some = order[c : c + CHUNK[1]]
                sims = cell.vectors[live] @ cell.matrix[some].T
                near, far = _similarity_bin(sims + off), _similarity_bin(sims - off)
                best = np.take_along_axis(ahead[live], near, axis=1) + 1
                worst = np.take_along_axis(ahead[live] + held[live, 0], far, axis=1)
                low = weights[0] * (best if weights[0] >= 0 else worst)
                high = weights[0] * (worst if weights[0] >= 0 else best)
                for i, (w, r) in enumerate(zip(weights[1:], ranks, strict=True), 1):
                    r = r[some]
                    g = (r - 1) // width
                    best = r[None, :] - upto[live, i][:, g]
                    worst = best + held[live, i][:, g]
                    low += w * (best if w >= 0 else worst)
                    high += w * (worst if w >= 0 else best)
                row = np.full(CHUNK[0], -1)
                row[live - at] = np.arange(len(live))
                here = (p[mine] >= c) & (p[mine] < c + CHUNK[1]) & (row[a[mine] - at] >= 0)
                where = row[a[mine][here] - at], p[mine][here] - c
                low[where] = high[where] = np.inf
                tops[live] = np.partition(np.hstack([tops[live], high]), k - 1, axis=1)[:, :k]
                limit[live] = tops[live].max(axis=1)
                bar = limit[live][:, None]
                who, which = np.nonzero((low <= bar + _slack(bar)) & np.isfinite(low))
                out.append((live[who], some[which], low[who, which], high[who, which]))
        who, which, low, high = (np.concatenate(x) for x in zip(*out, strict=True))
        keep = low <= limit[who] + _slack(limit[who])
        who, which, low, high = who[keep], which[keep], low[keep], high[keep]
        found = {"author_id": cell.authors[who], "paper_id": cell.papers[which]}
        found["similarity"] = np.round(exact(cell.vectors, who, cell.matrix, which), PLACES)
        return pd.DataFrame(found | {"low": low, "high": high} | {c: r[which] for c, r in zip(static, ranks, strict=True)})

    return run


def _slack(limit, size=np.abs):
    """Room for rounding in sums of weighted ranks."""
    return 1e-9 * (1 + size(limit))


def _ahead(cell: Cell, who: np.ndarray, own: np.ndarray, spot: np.ndarray) -> np.ndarray:
    """How many candidates of the cell are ahead of each survivor: author ``who``, similarity ``own``, before the paper at
    ``spot``. Survivors are in the order of author and similarity.

    A similarity belongs to the slot of its author between the survivors it is surely ahead of and the others; the counts
    of the slots add up to the candidates ahead. Those that float32 leaves undecided are computed again."""
    off, n_authors = error(cell.matrix.shape[1]), len(cell.authors)
    least = np.full(n_authors, np.inf)
    np.minimum.at(least, who, own)
    least = np.where(np.isfinite(least), below(least - off), np.float32(np.inf)).astype(np.float32)
    upper, lower = 4.0 * who + own + off, 4.0 * who + own - off
    after = np.append(who, n_authors)  # author of the first survivor that a similarity is not surely ahead of
    slots, ahead = np.zeros(len(who) + n_authors + 1, np.int64), np.zeros(len(who), np.int64)
    for at, c, sims, known in cell.tiles():
        sims[known] = NONE
        hit = np.flatnonzero(sims >= least[at : at + len(sims), None])
        if not len(hit):
            continue
        a = hit // sims.shape[1]
        key = sims.reshape(-1)[hit] + 4.0 * (a + at)
        mine = slice(*np.searchsorted(who, [at, at + len(sims)]))
        slot = np.searchsorted(upper[mine], key) + mine.start
        slots += np.bincount(slot + a + at, minlength=len(slots))
        open_ = np.flatnonzero((after[slot] == a + at) & (key >= np.append(lower, np.inf)[slot]))
        times = np.searchsorted(lower, key[open_], side="right") - slot[open_]
        item = np.repeat(open_, times)
        nth = slot[item] + np.arange(len(item)) - np.repeat(np.cumsum(times) - times, times)
        paper = hit[item] % sims.shape[1] + c
        again = np.round(exact(cell.vectors, who[nth], cell.matrix, paper), PLACES)
        wins = (again > own[nth]) | ((again == own[nth]) & (paper < spot[nth]))
        ahead += np.bincount(nth[wins & (paper != spot[nth])], minlength=len(who))
    upto = np.cumsum(slots)
    end = np.searchsorted(who, who, side="right")
    return ahead + upto[end + who] - upto[np.arange(len(who)) + who]


def _exact(static: Sequence[str]) -> Kernel:
    """Pass 3: (author_id, paper_id, ahead, x_...) of every survivor, as counted in this cell."""

    def run(key, left, right=None) -> pd.DataFrame:
        names = ["ahead", *[f"x_{c}" for c in static]]
        cell = _of(left, right, static)
        if not len(cell.authors) or not len(cell.papers) or cell.found is None:
            return _no_rows(["author_id", "paper_id", *names])
        found = cell.found.sort_values(["at", "similarity"])
        who, ids = found["at"].to_numpy().astype(np.int64), found["paper_id"].to_numpy()
        spot = np.searchsorted(cell.papers, ids)
        # Of another cell: before the paper at its place, never that paper itself.
        inside = cell.papers[np.minimum(spot, len(cell.papers) - 1)] == ids
        counts = {"ahead": _ahead(cell, who, found["similarity"].to_numpy(), np.where(inside, spot, spot - 0.5))}
        a, p = cell.known
        for c in static:
            mine, theirs = found[c].to_numpy().astype(np.int64), cell.static[c][p]
            stride = max(mine.max(), theirs.max(initial=0)) + 1
            sorted_known = np.sort(a * stride + theirs)
            counts[f"x_{c}"] = np.searchsorted(sorted_known, who * stride + mine) - np.searchsorted(sorted_known, who * stride)
        return pd.DataFrame({"author_id": cell.authors[who], "paper_id": ids} | counts)

    return run


def _over_pairs(kernel: Kernel, static: Sequence[str], schema: T.StructType, paper_block: int):
    """``kernel`` over each packed row of authors and all paper rows that a task pairs it with, as one cell. Authors go by
    their position in the row, papers by their number; the rows name the packed row (``ab``) as well."""
    names = [f.name for f in schema.fields]

    def papers_of(held: list[Row]) -> tuple:
        """Numbers, vectors, in both precisions, ranks and ids of all papers of the task."""
        nos = [p.numbers("_no") for p in held]
        no = np.concatenate(nos)
        matrix = np.concatenate([p.matrix(len(n)) for p, n in zip(held, nos, strict=True)])
        ranks = {c: np.concatenate([p.numbers(c) for p in held]) for c in static}
        if (no[1:] < no[:-1]).any():
            raise RuntimeError("paper rows must come in the order of their numbers")
        return no, matrix, matrix.astype(np.float32), ranks, pa.concat_arrays([p.ids("paper_id") for p in held])

    def cell_of(authors: Row, papers: tuple) -> Cell:
        no, matrix, single, ranks, _ = papers
        who, known = authors.numbers("known_at"), authors.numbers("known")
        at = np.searchsorted(no, known)
        here = np.flatnonzero(at < len(no))
        here = here[no[at[here]] == known[here]]
        n = len(authors.numbers("embedding", np.float64)) // matrix.shape[1]
        cell = Cell(np.arange(n), no, authors.matrix(n), matrix, (who[here], at[here]), ranks, block=paper_block, single=single)
        if authors.has("counts"):
            for one in authors.values["counts"].values:
                codes, counts = np.frombuffer(one.as_buffer(), np.int32).reshape(2, -1).astype(np.int64)
                cell.counts.append((codes // ((1 + len(static)) * BINS), codes % ((1 + len(static)) * BINS), counts))
        if authors.has("found_at"):
            frame = {"at": authors.numbers("found_at"), "paper_id": authors.numbers("found__no")}
            frame["similarity"] = authors.numbers("found_similarity", np.float64)
            cell.found = pd.DataFrame(frame | {c: authors.numbers(f"found_{c}") for c in static})
        return cell

    def results(ab: int, authors: Row, papers: tuple) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        out = kernel(None, cell_of(authors, papers))
        if not len(out):
            return
        who = out["author_id"].to_numpy().astype(np.int64)
        if "counts" in names:
            codes = who * (1 + len(static)) * BINS + out["code"].to_numpy()
            both = np.concatenate([codes, out["n"].to_numpy()]).astype(np.int32).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([ab], arrow.field("ab").type), pa.array([both], pa.binary())], schema=arrow)
            return
        no = out["paper_id"].to_numpy().astype(np.int64)
        columns = {"ab": np.full(len(out), ab), "at": who, "_no": no} | {c: out[c].to_numpy() for c in out.columns[2:]}
        if "author_id" in names:
            columns["author_id"] = authors.ids("author_id").take(pa.array(who))
            columns["paper_id"] = papers[-1].take(pa.array(np.searchsorted(papers[0], no)))
        arrays = [columns[f.name] if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name]) for f in arrow]
        table = pa.Table.from_arrays([x.cast(f.type) for x, f in zip(arrays, arrow, strict=True)], schema=arrow)
        yield from table.to_batches(max_chunksize=65536)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = []

        def done(state: tuple, held: dict) -> Iterator[pa.RecordBatch]:
            if not whole:
                whole.append(papers_of(list(held.values())))
                held.update(dict.fromkeys(held))
            return results(*state, whole[0])

        return over_pairs(batches, lambda row: row, lambda ab, authors: (ab, authors), lambda state, papers: None, done)

    return run


def weighted_top_k(
    authors: DataFrame,
    papers: DataFrame,
    known: DataFrame,
    k: int,
    weights: Sequence[float],
    static: dict[str, str],
    author_block: int = AUTHOR_BLOCK,
    paper_block: int = PAPER_BLOCK,
) -> DataFrame:
    """The k best (author_id, paper_id, similarity, cos_rank, ranks..., rank) per author, known pairs left out.

    ``authors`` (author_id, embedding) and ``papers`` (paper_id, embedding, static ranks) hold unit vectors,
    materialised; of ``known`` (author_id, paper_id) only papers of ``papers`` count. ``static`` maps each rank's
    name in the result to its column in ``papers``, numbered from 1 without gaps; ``weights`` start with the
    cosine rank's. The block sizes bound a task's work and do not change the result."""
    spark = authors.sparkSession
    papers = numbered(papers)
    n_authors, n_papers = authors.count(), papers.count()
    columns = list(static.values())
    id_types = [authors.schema["author_id"], papers.schema["paper_id"]]
    integer = lambda *names: [T.StructField(n, T.IntegerType()) for n in names]
    long = lambda *names: [T.StructField(n, T.LongType()) for n in names]
    double = lambda *names: [T.StructField(n, T.DoubleType()) for n in names]
    width = max(1, math.ceil(n_papers / BINS))
    nb = max(1, math.ceil(n_papers / PACK))
    parts = math.ceil(nb / PACKS)
    na = max(1, math.ceil(n_authors / author_block), min(n_authors, math.ceil(spark.sparkContext.defaultParallelism / parts)))
    ranks = [F.col(c).cast("bigint").alias(c) for c in columns]
    right = pack(
        papers.select(F.col("_no").cast("bigint").alias("_no"), "paper_id", "embedding", *ranks), (F.col("_no") / PACK).cast("int"), parts, "_no"
    )
    a_parts = author_parts(na, parts, spark.sparkContext.defaultParallelism)
    left = pack(with_known(authors, known, papers), block_of("author_id", na), a_parts)

    def cells(rows: DataFrame, kernel: Kernel, schema: list[T.StructField]) -> DataFrame:
        out = T.StructType(schema)
        return pairs(rows, right).mapInArrow(_over_pairs(kernel, columns, out, paper_block), out)

    counted = cells(left, _count(columns, width), [*integer("ab"), T.StructField("counts", T.BinaryType())])
    # At most (1 + ranks) * BINS counts an author and task.
    held = counted.groupBy(F.col("ab").alias("pack")).agg(F.collect_list("counts").alias("counts"))
    maybe = cells(
        place(left.drop("first").join(held, "pack", "left"), a_parts), _bound(k, [float(w) for w in weights], columns, width),
        [*integer("ab", "at"), *long("_no"), *id_types, *double("similarity", "low", "high"), *long(*columns)],
    )
    maybe = cut_lineage(maybe)
    author = ["ab", "at"]
    by_high = top_k_per_group(maybe, author, [F.col("high"), F.col("_no")], k, "nth")
    limits = by_high.groupBy(*author).agg(F.count(F.lit(1)).alias("n"), F.max("high").alias("limit"))
    limit = F.when(F.col("n") == k, F.col("limit")).otherwise(float("inf"))
    survivors = cut_lineage(
        maybe.join(limits, author).where(F.col("low") <= limit + _slack(limit, F.abs)).select(*maybe.columns)
    )
    rows = F.struct(F.col("at").cast("bigint").alias("found_at"), *[F.col(c).alias(f"found_{c}") for c in ("_no", "similarity", *columns)])
    found = flat(survivors.groupBy(F.col("ab").alias("pack")).agg(F.collect_list(rows).alias("rows")))
    counts = cells(
        place(left.drop("first").join(found, "pack"), a_parts),
        _exact(columns), [*integer("ab", "at"), *long("_no", "ahead", *[f"x_{c}" for c in columns])],
    )
    summed = counts.groupBy(*author, "_no").agg(*[F.sum(c).alias(c) for c in counts.columns[3:]])
    scored = (
        survivors.join(summed, [*author, "_no"])
        .select(
            *author, "_no", "author_id", "paper_id", "similarity", (F.col("ahead") + 1).alias("cos_rank"),
            *[(F.col(c) - F.col(f"x_{c}")).alias(n) for n, c in static.items()],
        )
        .withColumn("rank", linear_score(["cos_rank", *static], weights))
    )
    return top_k_per_group(scored, author, [F.col("rank"), F.col("_no")], k, "_rn").drop("_rn", "_no", *author)
