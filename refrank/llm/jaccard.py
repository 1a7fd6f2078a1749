"""N-gram Jaccard self-join by partitioning the universe of shingles (pigeonhole on segments).

Sets are banded by size. In a band the universe is split by hash into m segments; two sets that link differ
in at most H elements, so in all but H segments they are equal. A set is indexed in its own band under the
digest of each of its segments, and probes its own band and those below that hold sizes it may link with,
for partners of its own size or less. A probe gives every segment an allowance v of -1 (left out), 0 (equal) or
1 (equal, or one element more or less); if the allowances plus one sum to H + 1, no partner is missed.

The allowance is chosen by cost: a first shuffle of the digests shows how many sets share each one. Segments
that nobody shares count for nothing at no cost; of the shared ones a set takes the least frequent that
it needs, and one whose cheapest choice still holds a crowded segment (``HOT`` sets or more) widens segments
of its own to their one-deletion neighbourhood instead. A digest is a sum of element hashes, so a
neighbour is one subtraction; neighbours are looked up in one more pass, behind a filter of fixed size.

Equal sets are one class before anything else. Candidates are verified on the shingles themselves: first every
prober of a segment against one member of it, then, where a segment still holds more than one component, all pairs
across components that a parity sketch cannot rule out, inside tasks of bounded blocks that return a link
only when it joins two components. No group is ever expanded into its pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refrank.llm.base import id_text, materialise, row_key
from refrank.llm.components import star_components

WORDS = 3
PERCENT = 90
BAND = 1.25  # largest size of a band over its smallest
SPARE = 10  # one more segment than needed for so many; what a probe may leave out
HOT = 1024
RUN = 1 << 20  # rows of a segment that are counted; more are only known to be so many
BLOCK = 512
SMALL = 32  # members of a bucket whose hopeful pairs go straight to verification
SKETCH = 256  # bits
FILTER = 1 << 22  # positions of a row or digest filter
SEG = 24  # bits of a slot that number the segment

U = np.uint64
GOLDEN, MIX1, MIX2 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> U(30))) * MIX1
    x = (x ^ (x >> U(27))) * MIX2
    return x ^ (x >> U(31))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingle_set(text: str, words: int = WORDS) -> set[tuple[bytes, ...]]:
    """The distinct shingles of a text; the whole sequence if it is shorter; empty without words."""
    parts = words_of(text)
    if len(parts) < words:
        return {tuple(parts)} if parts else set()
    return set(zip(*(parts[i:] for i in range(words)), strict=False))


def shingle_hashes(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of :func:`shingle_set`."""
    parts = words_of(text)
    if not parts:
        return np.empty(0, np.uint64)
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))
    size = min(words, len(parts))
    total = np.full(len(parts) - size + 1, U(size))
    for i in range(size):
        total = mixed(total * GOLDEN + each[i : len(each) - size + 1 + i])
    return np.unique(total)


def differ(a: int, b: int, percent: int) -> int:
    """Elements by which linked sets of a and b elements may differ."""
    return (a + b) * (100 - percent) // (100 + percent)


@cache
def bands(percent: int) -> list[tuple[int, int, int]]:
    """(smallest size, largest size, segments) of each band; no segments where only equal sets can link."""
    out, low = [], 1
    while low < 1 << 40:
        high = int(low * BAND)
        most = differ(high, high * 100 // percent, percent)
        out.append((low, high, most + 1 + max(1, most // SPARE) if most else 0))
        low = high + 1
    return out


def probed(n: int, percent: int) -> list[int]:
    """The bands that a set of n elements probes: its own first, then those below that it may link with."""
    every = bands(percent)
    own = next(k for k, (_, high, _) in enumerate(every) if n <= high)
    least = -(-n * percent // 100)
    return [k for k in range(own, -1, -1) if every[k][1] >= least]


def segments(hashes: np.ndarray, band: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(segment of each element, sum of each segment) in a band."""
    m = bands(percent)[band][2]
    seg = ((hashes >> U(8)) % U(max(1, m))).astype(np.int64)
    sums = np.zeros(m, np.uint64)
    if m:
        np.add.at(sums, seg, hashes)
    return seg, sums


def digests(sums: np.ndarray, band: int, seg: np.ndarray, space: int = 0) -> np.ndarray:
    """Bucket keys; ``space`` 1 and 2 are the buckets of exact and of one-deletion neighbours."""
    return mixed(sums + GOLDEN * ((U(band) << U(32)) + (U(space) << U(48)) + seg.astype(np.uint64) + U(1)))


def signatures(hashes: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The digests of all segments, own band first."""
    out = []
    for band in probed(len(hashes), percent) if len(hashes) else []:
        sums = segments(hashes, band, percent)[1]
        out.append(digests(sums, band, np.arange(len(sums))))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def sketch(hashes: np.ndarray) -> bytes:
    """Parity of the elements by hash position: sets that differ in d elements have sketches that differ in d bits at most."""
    return np.packbits(np.bincount((hashes & U(SKETCH - 1)).astype(np.int64), minlength=SKETCH).astype(np.uint8) & 1).tobytes()


def text_sets(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(doc_id, row_key, n, key, sketch, sigs) per row; ``key`` is the 128-bit digest of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, key, mark, sigs = [], [], [], []
            for t in b.column(2).to_pylist():
                h = shingle_hashes(t, words)
                n.append(len(h))
                key.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest())
                mark.append(sketch(h))
                sigs.append(signatures(h, percent).tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(n, pa.int64()), *(pa.array(x, pa.binary()) for x in (key, mark, sigs))],
                ["doc_id", "row_key", "n", "key", "sketch", "sigs"],
            )

    rows = id_text(docs).select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("row_key"), "text")
    return rows.mapInArrow(run, "doc_id long, row_key string, n long, key binary, sketch binary, sigs binary")


def _runs(batches: Iterator[pa.RecordBatch], column: str, most: int | None = None) -> Iterator[pa.Table]:
    """Tables of whole runs of equal values of a sorted column; a run longer than ``most`` comes in pieces."""
    kept: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        v = b.column(column).to_numpy(zero_copy_only=False)
        if kept and kept[-1].column(column)[-1].as_py() != v[0]:
            yield pa.Table.from_batches(kept)
            kept = []
        last = int(np.searchsorted(v, v[-1]))
        if last:
            yield pa.Table.from_batches([*kept, b.slice(0, last)])
            kept = []
        kept.append(b.slice(last))
        if most and sum(x.num_rows for x in kept) >= most:
            yield pa.Table.from_batches(kept)
            kept = []
    if kept:
        yield pa.Table.from_batches(kept)


def _cuts(values: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1], [True])))


def shared_segments(classes: DataFrame, percent: int) -> DataFrame:
    """(cid, slot, count): the segments of each class whose bucket holds another class and an indexed one.

    ``slot`` is the band (0 own, 1 the one below, ...) and the segment; ``count`` the size of the bucket."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sigs, slots, times = [], [], []
            for n, raw in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                sigs.append(np.frombuffer(raw, np.int64))
                sizes = [bands(percent)[k][2] for k in probed(n, percent)]
                slots += [np.arange(m, dtype=np.int32) + (back << SEG) for back, m in enumerate(sizes)]
                times.append(sum(sizes))
            if sum(times):
                out = pa.Table.from_arrays(
                    [
                        pa.array(np.concatenate(sigs)),
                        pa.array(np.repeat(b.column(0).to_numpy(), times)),
                        pa.array(np.concatenate(slots)),
                    ],
                    names=["sig", "cid", "slot"],
                )
                yield from out.to_batches(max_chunksize=1 << 16)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, "sig", RUN):
            cuts = _cuts(t["sig"].to_numpy())
            size = np.diff(cuts)
            indexed = np.add.reduceat((t["slot"].to_numpy() < 1 << SEG).astype(np.int64), cuts[:-1])
            count = np.repeat(np.where((size > 1) & (indexed > 0) | (size >= RUN), size, 0), size)
            left = np.flatnonzero(count)
            if len(left):
                out = t.take(pa.array(left)).append_column("count", pa.array(count[left].astype(np.int32)))
                yield from out.combine_chunks().to_batches(max_chunksize=1 << 16)

    each = classes.select("cid", "n", "sigs").mapInArrow(spread, "sig long, cid long, slot int")
    return each.repartition("sig").sortWithinPartitions("sig").mapInArrow(keep, "sig long, cid long, slot int, count int")


def allocate(n: int, slots: np.ndarray, counts: np.ndarray, percent: int, hot: int) -> tuple[np.ndarray, list[int]]:
    """(which of the shared segments a set probes, slots that it widens to one deletion)."""
    chosen, wide = np.zeros(len(slots), bool), []
    for back, band in enumerate(probed(n, percent)):
        _, high, m = bands(percent)[band]
        if not m:
            continue
        own = np.flatnonzero(slots >> SEG == back)
        need = differ(n, min(n, high), percent) + 1 - (m - len(own))  # segments that nobody shares are free
        if need <= 0:
            continue
        cheap = own[np.argsort(counts[own], kind="stable")][:need]
        crowded = cheap[counts[cheap] >= hot]
        if len(crowded):
            held = set(slots[crowded].tolist()) | set(slots[own].tolist()) - set(slots[cheap].tolist())
            spots = [s for s in range(back << SEG, (back << SEG) + m) if s not in held][: len(crowded)]
            wide += spots
            cheap = cheap[: len(cheap) - len(spots)]  # the most crowded are left out, one for each widened
        chosen[cheap] = True
    return chosen, wide


MEMBER = "sig long, cid long, n long, sketch binary, probe boolean, indexed boolean"


def allocated(shared: DataFrame, classes: DataFrame, percent: int, hot: int) -> DataFrame:
    """(MEMBER columns, slot): rows of buckets; a row with ``slot`` is a segment to widen instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, "cid"):
            t = t.combine_chunks()
            cid, slots, counts, sizes = (t[c].to_numpy() for c in ("cid", "slot", "count", "n"))
            cuts = _cuts(cid)
            probe, wide = np.zeros(len(cid), bool), []
            for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                probe[a:z], more = allocate(int(sizes[a]), slots[a:z], counts[a:z], percent, hot)
                wide += [(a, s) for s in more]
            indexed = slots < 1 << SEG
            rows = np.concatenate([np.flatnonzero(probe | indexed), np.array([w[0] for w in wide], np.int64)])
            extra = pa.array([None] * (len(rows) - len(wide)) + [w[1] for w in wide], pa.int32())
            out = t.take(pa.array(rows))
            yield from (
                pa.table(
                    [out["sig"], out["cid"], out["n"], out["sketch"], pa.array(probe[rows]), pa.array(indexed[rows]), extra],
                    ["sig", "cid", "n", "sketch", "probe", "indexed", "slot"],
                )
                .combine_chunks()
                .to_batches(max_chunksize=1 << 15)
            )

    joined = shared.join(classes.select("cid", "n", "sketch"), "cid")
    # a class must be whole in its task: the join may broadcast, or split a skewed partition
    return joined.repartition("cid").sortWithinPartitions("cid").mapInArrow(run, MEMBER + ", slot int")


def _filter(values: DataFrame) -> np.ndarray:
    """Packed positions of a bigint column ``v``: FILTER bits, whatever the number of rows."""
    spots = values.select((F.pmod("v", F.lit(FILTER))).cast("int").alias("v")).distinct()
    octets = spots.groupBy(F.expr("v div 8").alias("at")).agg(F.expr("bit_or(shiftleft(1, v % 8))").alias("octet"))
    out = np.zeros(FILTER // 8, np.uint8)
    for r in octets.coalesce(8).toLocalIterator():  # FILTER / 8 rows at most
        out[r.at] = r.octet
    return out


def _passes(octets: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = values % FILTER
    return (octets[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def class_texts(docs: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(cid, text) of the representatives of the classes in ``wanted`` (cid).

    A filter of fixed size holds most other texts back before the shuffle."""
    keys = classes.select("cid", "row_key").join(wanted.select("cid").distinct(), "cid")
    octets = _filter(keys.select(F.xxhash64("row_key").alias("v")))
    shared = docs.sparkSession.sparkContext.broadcast(octets)  # FILTER bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left = np.flatnonzero(_passes(shared.value, b.column(0).to_numpy()))
            if len(left):
                yield b.take(pa.array(left))

    key = row_key(F.col("doc_id"), F.col("text"))
    rows = id_text(docs).select(F.xxhash64(key).alias("v"), key.alias("row_key"), "text")
    few = rows.mapInArrow(run, "v long, row_key string, text string").drop("v")
    return keys.join(few, "row_key").groupBy("cid").agg(F.any_value("text").alias("text"))


def neighbours(docs: DataFrame, classes: DataFrame, wide: DataFrame, words: int, percent: int) -> DataFrame:
    """MEMBER rows of the one-deletion buckets that the widened segments of ``wide`` (cid, slot) ask for.

    A prober's segment r meets s = r without one element among exact segments (space 1), and s with one more
    element among one-deletion neighbours (space 2)."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sigs, cids = [], []
            for cid, slots, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                h = shingle_hashes(text, words)
                of = probed(len(h), percent)
                for back in {s >> SEG for s in slots}:
                    seg, sums = segments(h, of[back], percent)
                    mine = np.array([s & (1 << SEG) - 1 for s in slots if s >> SEG == back], np.int64)
                    at = np.flatnonzero(np.isin(seg, mine))
                    found = [digests(sums[mine], of[back], mine, 2), digests(sums[seg[at]] - h[at], of[back], seg[at], 1)]
                    sigs += found
                    cids.append(np.full(sum(map(len, found)), cid))
            if sigs:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.concatenate(cids))], ["sig", "cid"]
                )

    slots = wide.groupBy("cid").agg(F.collect_list("slot").alias("slots"))  # at most the segments of one text
    asked = slots.join(class_texts(docs, classes, wide), "cid").select("cid", "slots", "text")
    asked = materialise(asked.mapInArrow(ask, "sig long, cid long"))
    shared = docs.sparkSession.sparkContext.broadcast(_filter(asked.select(F.col("sig").alias("v"))))  # FILTER bits

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        octets, wanted = shared.value, spots.value
        for b in batches:
            for cid, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                h = shingle_hashes(text, words)
                band = probed(len(h), percent)[0]
                mine = wanted[band]
                seg, sums = segments(h, band, percent)
                at = np.flatnonzero(np.isin(seg, mine))
                sigs = np.concatenate([digests(sums[mine], band, mine, 1), digests(sums[seg[at]] - h[at], band, seg[at], 2)])
                sigs = np.unique(sigs).view(np.int64)
                sigs = sigs[_passes(octets, sigs)]
                if len(sigs):
                    yield pa.RecordBatch.from_arrays([pa.array(sigs), pa.array(np.full(len(sigs), cid))], ["sig", "cid"])

    # only sets of the bands asked for can answer, with the segments asked for
    by_band: dict[int, set[int]] = {}
    for r in wide.join(classes.select("cid", "n"), "cid").select("n", "slot").distinct().coalesce(8).toLocalIterator():
        by_band.setdefault(probed(r.n, percent)[r.slot >> SEG], set()).add(r.slot & (1 << SEG) - 1)
    spots = docs.sparkSession.sparkContext.broadcast(  # at most the segments of the bands
        {k: np.array(sorted(v), np.int64) for k, v in by_band.items()}
    )
    sizes = [(F.col("n") >= bands(percent)[k][0]) & (F.col("n") <= bands(percent)[k][1]) for k in by_band]
    able = classes.where(reduce(lambda x, y: x | y, sizes))
    held = class_texts(docs, classes, able).mapInArrow(answer, "sig long, cid long")
    of_class = classes.select("cid", "n", "sketch")
    probes = asked.distinct().join(of_class, "cid").select("sig", "cid", "n", "sketch", F.lit(True).alias("probe"), F.lit(False).alias("indexed"))
    index = held.join(of_class, "cid").select("sig", "cid", "n", "sketch", F.lit(False).alias("probe"), F.lit(True).alias("indexed"))
    return probes.union(index)


def may_link(n: np.ndarray, marks: np.ndarray, a: int | np.ndarray, b: int | np.ndarray, percent: int) -> np.ndarray:
    """Whether size and sketch leave the pairs (a, b) a chance."""
    size = 100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b])
    most = (n[a] + n[b]) * (100 - percent) // (100 + percent)
    return size & (np.bitwise_count(marks[a] ^ marks[b]).sum(-1) <= most)


def _marks(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, SKETCH // 64)


def to_first(members: DataFrame, percent: int) -> DataFrame:
    """(a, b): every prober of a bucket with the smallest indexed class in it, if size and sketch allow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: tuple | None = None  # sig, cid, n, mark of the bucket that goes on
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            sig, cid, n, probe, indexed = (t[c].to_numpy() for c in ("sig", "cid", "n", "probe", "indexed"))
            marks, cuts = _marks(t["sketch"]), _cuts(sig)
            head = np.repeat(cuts[:-1], np.diff(cuts))
            goes_on = sig == first[0] if first else np.zeros(len(sig), bool)
            pivot = np.where(goes_on, first[1] if first else 0, cid[head])
            pivot_n = np.where(goes_on, first[2] if first else 0, n[head])
            pivot_mark = np.where(goes_on[:, None], first[3] if first else marks[:1], marks[head])
            ok = probe & (cid != pivot) & (goes_on | indexed[head])
            both_n, both = np.concatenate([n, pivot_n]), np.concatenate([marks, pivot_mark])
            at = np.flatnonzero(ok)
            at = at[may_link(both_n, both, at, at + len(n), percent)]
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(cid[at]), pa.array(pivot[at])], ["a", "b"])
            last = cuts[-2]
            if not goes_on[last]:
                first = (sig[last], cid[last], n[last], marks[last].copy()) if indexed[last] else None

    order = members.repartition("sig").sortWithinPartitions("sig", F.desc("indexed"), "cid")
    return order.mapInArrow(run, "a long, b long").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def linked(a: set, b: set, percent: int) -> bool:
    both = len(a & b)
    return 100 * both >= percent * (len(a) + len(b) - both)


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose shingle sets link."""
    ends = pairs.select(F.col("a").alias("cid")).union(pairs.select(F.col("b").alias("cid")))
    texts = materialise(class_texts(docs, classes, ends))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, set()
        for batch in batches:
            keep = []
            for k, (b, text, other) in enumerate(zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True)):
                if b != at:
                    at, own = b, shingle_set(other, words)
                if linked(shingle_set(text, words), own, percent):
                    keep.append(k)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), batch.column(1).take(pa.array(keep, pa.int64()))], ["a", "b"])

    with_a = pairs.join(texts.withColumnRenamed("cid", "a").withColumnRenamed("text", "text_a"), "a")
    both = with_a.join(texts.withColumnRenamed("cid", "b").withColumnRenamed("text", "text_b"), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def cross_pairs(t: pa.Table, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """(prober row, rows of indexed members of other components that size and sketch leave)."""
    n, probe, indexed, comp = (t[c].to_numpy() for c in ("n", "probe", "indexed", "comp"))
    marks = _marks(t["sketch"])
    held = np.flatnonzero(indexed)
    for p in np.flatnonzero(probe).tolist():
        other = held[comp[held] != comp[p]]
        other = other[may_link(n, marks, p, other, percent)]
        if len(other):
            yield p, other


def short_pairs(t: pa.Table, group: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The hopeful pairs of rows of short groups, all groups at once: row against row at distance 1, 2, ..."""
    n, probe, indexed, comp = (t[c].to_numpy() for c in ("n", "probe", "indexed", "comp"))
    marks, found = _marks(t["sketch"]), []
    at = np.arange(len(group))
    for step in range(1, len(group)):
        at = at[: np.searchsorted(at, len(group) - step)]
        at = at[group[at] == group[at + step]]
        if not len(at):
            break
        other = at + step
        ok = (probe[at] & indexed[other] | probe[other] & indexed[at]) & (comp[at] != comp[other])
        hit = at[ok]
        hit = hit[may_link(n, marks, hit, hit + step, percent)]
        found.append((hit, hit + step))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def across(members: DataFrame, roots: DataFrame, docs: DataFrame, classes: DataFrame, words: int, percent: int, block: int) -> DataFrame:
    """(a, b): links that join components of ``roots`` (node, root) inside a bucket.

    A bucket of more than ``block`` members is split by class; every pair of parts is a group of its own. Groups
    of ``SMALL`` members or fewer give their hopeful pairs to :func:`verified`; a larger one is verified in a
    task of its own that keeps components and compares no two members it knows to be connected."""
    rooted = members.join(roots.withColumnRenamed("node", "cid"), "cid", "left")
    rooted = materialise(rooted.withColumn("comp", F.coalesce("root", "cid")).drop("root"))
    live = (
        rooted.groupBy("sig")
        .agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("size"))
        .where("low <> high")
        .select("sig", F.ceil(F.col("size") / block).cast("int").alias("parts"))
    )
    part = F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    split = rooted.join(live, "sig").withColumn("part", part).withColumn("other", other)
    # two groups with one hash would only be compared needlessly
    group = F.xxhash64("sig", F.least("part", "other"), F.greatest("part", "other")).alias("group")
    fields = ["cid", "n", "sketch", "probe", "indexed", "comp"]
    shape = "group long, cid long, n long, sketch binary, probe boolean, indexed boolean, comp long"

    def hopeful(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, "group"):
            t = t.combine_chunks()
            cuts = _cuts(t["group"].to_numpy())
            size = np.repeat(np.diff(cuts), np.diff(cuts))
            few = t.take(pa.array(np.flatnonzero(size <= SMALL)))
            a, b = short_pairs(few, few["group"].to_numpy(), percent)
            if len(a):
                pairs = few.take(pa.array(a)).append_column("other", few["cid"].take(pa.array(b)))
                yield from pairs.combine_chunks().to_batches(max_chunksize=1 << 15)
            for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if y - x > SMALL:
                    own = t.slice(x, y - x)
                    seen = np.zeros(y - x, bool)
                    for p, others in cross_pairs(own, percent):
                        seen[p] = seen[others] = True
                    left = own.take(pa.array(np.flatnonzero(seen)))
                    yield from left.append_column("other", pa.nulls(left.num_rows, pa.int64())).combine_chunks().to_batches()

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, "group"):
            t = t.combine_chunks()
            cuts = _cuts(t["group"].to_numpy())
            for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                out = joining(t.slice(x, y - x), words, percent)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out]), pa.array([o[1] for o in out])], ["a", "b"])

    ordered = split.select(group, *fields).repartition("group").sortWithinPartitions("group")
    found = materialise(ordered.mapInArrow(hopeful, shape + ", other long"))
    pairs = found.where("other is not null").select(F.greatest("cid", "other").alias("a"), F.least("cid", "other").alias("b"))
    short = verified(materialise(pairs.distinct()), docs, classes, words, percent)
    left = found.where("other is null").select("group", *fields)
    texts = class_texts(docs, classes, left)
    long = left.join(texts, "cid").repartition("group").sortWithinPartitions("group", "cid")
    return short.union(long.select("group", *fields, "text").mapInArrow(link, "a long, b long").distinct())


def joining(t: pa.Table, words: int, percent: int) -> list[tuple[int, int]]:
    """Verified links of one group that join two components; members known to be connected are not compared."""
    cid, comp, text = t["cid"].to_pylist(), t["comp"].to_pylist(), t["text"]
    sets: dict[int, set] = {}
    root: dict[int, int] = {}

    def top(c: int) -> int:
        while root.get(c, c) != c:
            c = root[c]
        return c

    def of(k: int) -> set:
        if k not in sets:
            sets[k] = shingle_set(text[k].as_py(), words)
        return sets[k]

    out = []
    for p, other in cross_pairs(t, percent):
        for s in other.tolist():
            x, y = top(comp[p]), top(comp[s])
            if x != y and linked(of(p), of(s), percent):
                root[max(x, y)] = min(x, y)
                out.append((cid[p], cid[s]))
    return out


def jaccard_groups(
    docs: DataFrame, words: int = WORDS, percent: int = PERCENT, hot: int = HOT, block: int = BLOCK
) -> DataFrame:
    """(doc_id, n_shingles, component_id, row_key) per input row.

    A set holds the distinct word shingles (A-Z lower-cased), or the whole sequence if it is shorter; two sets
    link when 100 * intersection >= ``percent`` * union. ``component_id`` is the smallest doc_id reachable over links,
    itself included (NULL where the whole group has no id). NULL, empty and blank texts have an empty set,
    link with nothing and keep their own id. Repeated rows have equal sets and so one component; an empty
    table gives an empty result. Other columns are ignored. ``hot`` and ``block`` set cost, not results.

    Sets are told equal by a 128-bit digest of their 64-bit shingle hashes; all other links are verified on the
    shingles themselves."""
    rows = materialise(text_sets(docs, words, percent))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key")).alias("first")
    classes = (
        rows.where("n > 0")
        .groupBy("key")
        .agg(first, *(F.any_value(c).alias(c) for c in ("n", "sketch", "sigs")))
        .select("key", "first.doc_id", "first.row_key", "n", "sketch", "sigs", F.monotonically_increasing_id().alias("cid"))
    )
    classes = materialise(classes)
    found = materialise(allocated(shared_segments(classes, percent), classes, percent, hot))
    members = found.where("slot is null").drop("slot")
    wide = found.where("slot is not null").select("cid", "slot")
    if wide.limit(1).count():
        members = members.union(materialise(neighbours(docs, classes, wide, words, percent)))
    links = materialise(verified(materialise(to_first(members, percent)), docs, classes, words, percent))
    roots = star_components(links)
    more = materialise(across(members, roots, docs, classes, words, percent, block))
    if more.limit(1).count():
        roots = star_components(roots.toDF("a", "b").union(more))
    rooted = classes.join(roots.withColumnRenamed("node", "cid"), "cid", "left").select(
        "key", "doc_id", F.coalesce("root", "cid").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_set = rooted.join(least, "root").select("key", "component_id", F.lit(True).alias("held"))
    return rows.join(of_set, "key", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("held"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        "row_key",
    )
