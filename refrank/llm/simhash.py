"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints that differ in at most ``2 r`` bits have a common variant within ``r`` bits of
both, and two that share such a variant differ in at most ``2 r`` bits. So every distinct fingerprint
emits its whole ball of radius ``r`` (2,081 variants for r = 2), variants meet in a shuffle, and equal
variants are links with no false positives.

The ball is never shipped variant by variant. The shuffle key is the variant's top ``prefix_bits``
bits: a fingerprint travels once to each prefix its ball touches (1 + p + p(p-1)/2 rows), and the task
that owns the prefix emits the variants with that prefix from the flips that are left. Inside a variant
every member is linked to the smallest one, never to all others.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refrank.llm.base import id_text, materialise, row_key
from refrank.llm.components import star_components

SEED = 42
SHINGLE_WORDS = 4
MAX_BITS = 4
PREFIX_BITS = 14  # at least; see prefix_bits_for
PREFIX_ROWS = 1 << 20  # of an average prefix, at most
CHUNK = 1 << 21  # variants expanded at a time in a task


def text_fingerprint(text: str, words: int = SHINGLE_WORDS) -> int:
    """SimHash of the word shingles of a text (A-Z lower-cased), as an unsigned 64-bit integer."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    if len(parts) < words:
        hashes = [digest(joined, SEED)]
    else:
        hashes = [
            digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[words - 1 :].tolist(), strict=False)
        ]
    counts = np.zeros(64, np.int64)
    every = np.array(hashes, dtype="<u8")
    for k in range(0, len(every), 65536):
        octets = every[k : k + 65536].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(every), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, row_key, fp bigint) per input row; an empty or NULL text has fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([text_fingerprint(t, words) for t in b.column(2).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(fps.view(np.int64))], ["doc_id", "row_key", "fp"]
            )

    rows = id_text(docs).select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("row_key"), "text")
    return rows.mapInArrow(run, "doc_id long, row_key string, fp long")


def flip_masks(bits: int, most: int) -> np.ndarray:
    """Every mask over the low ``bits`` bits with at most ``most`` bits set."""
    return np.array(
        [sum(1 << i for i in c) for n in range(min(bits, most) + 1) for c in combinations(range(bits), n)],
        dtype=np.uint64,
    )


def _meet(values: np.ndarray, owners: np.ndarray) -> np.ndarray:
    """(owner, smallest owner) pairs of the values that more than one row has."""
    ordered = np.sort(values)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return np.empty((0, 2), np.uint64)
    at = np.searchsorted(twice, values)
    hit = twice[np.minimum(at, len(twice) - 1)] == values
    values, owners = values[hit], owners[hit]
    order = np.lexsort((owners, values))
    values, owners = values[order], owners[order]
    first = np.concatenate(([True], values[1:] != values[:-1]))
    smallest = owners[first][np.cumsum(first) - 1]
    pairs = np.stack([owners, smallest], axis=1)[owners != smallest]
    return np.unique(pairs, axis=0)


def ball_links(fps: np.ndarray, owners: np.ndarray, used: np.ndarray, free: int, radius: int) -> list[np.ndarray]:
    """Links among the variants of ``fps`` that keep all but the low ``free`` bits.

    ``used`` flips of each row are already spent. Work that is too large for one array is split on the
    next four bits, so memory stays bounded however many fingerprints share a prefix."""
    masks = {j: flip_masks(free, radius - j) for j in range(radius + 1)}
    total = sum(int((used == j).sum()) * len(m) for j, m in masks.items())
    if total > CHUNK and free > 4:
        out, low = [], np.uint64(free - 4)
        nibble = (fps >> low) & np.uint64(15)
        for s in range(16):
            spent = used + np.bitwise_count(nibble ^ np.uint64(s))
            ok = spent <= radius
            if ok.sum() > 1:
                moved = fps[ok] ^ ((nibble[ok] ^ np.uint64(s)) << low)
                out += ball_links(moved, owners[ok], spent[ok], free - 4, radius)
        return out
    values, who = [], []
    for j, m in masks.items():
        rows = used == j
        values.append((fps[rows][:, None] ^ m[None, :]).ravel())
        who.append(np.repeat(owners[rows], len(m)))
    return [_meet(np.concatenate(values), np.concatenate(who))]


def prefix_bits_for(distinct: int, max_bits: int = MAX_BITS) -> int:
    """Bits of the shuffle key at which a prefix has ``PREFIX_ROWS`` rows or fewer on average."""
    sent = lambda p: distinct * sum(comb(p, j) for j in range(max_bits // 2 + 1))
    return next((p for p in range(PREFIX_BITS, 31) if sent(p) <= PREFIX_ROWS * 2**p), 31)


def near_links(distinct: DataFrame, max_bits: int = MAX_BITS, prefix_bits: int = PREFIX_BITS) -> DataFrame:
    """(a, b): pairs of ``distinct`` (fp bigint) whose connected components are those of the links at
    ``max_bits`` or fewer differing bits. ``max_bits`` is even: a ball has half of it as radius."""
    radius, free = max_bits // 2, 64 - prefix_bits
    if max_bits % 2 or not 1 <= prefix_bits <= 31:
        raise ValueError("max_bits must be even, prefix_bits from 1 to 31")
    prefixes = [int(m) for m in flip_masks(prefix_bits, radius)]

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, np.ndarray]] = []

        def flush(prefix: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
            own = fps >> np.uint64(free)
            used = np.bitwise_count(own ^ prefix).astype(np.int64)
            moved = fps ^ ((own ^ prefix) << np.uint64(free))
            cuts = np.flatnonzero(np.concatenate(([True], prefix[1:] != prefix[:-1], [True])))
            at = 0
            while at < len(cuts) - 1:  # whole prefixes, about a chunk of variants at a time
                to = at + 1
                while to < len(cuts) - 1 and cuts[to + 1] - cuts[at] <= 4096:
                    to += 1
                rows = slice(cuts[at], cuts[to])
                for pairs in ball_links(moved[rows], fps[rows], used[rows], free, radius):
                    if len(pairs):
                        pairs = pairs.view(np.int64)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"]
                        )
                at = to

        for b in batches:  # sorted by prefix; the last prefix of a batch may go on in the next
            prefix = b.column(0).to_numpy().astype(np.uint64)
            fps = b.column(1).to_numpy().view(np.uint64)
            if not len(prefix):
                continue
            last = int(np.searchsorted(prefix, prefix[-1]))
            if last or (kept and kept[-1][0][-1] != prefix[0]):
                kept.append((prefix[:last], fps[:last]))
                yield from flush(*(np.concatenate(x) for x in zip(*kept, strict=True)))
                kept = []
            kept.append((prefix[last:], fps[last:]))
        if kept:
            yield from flush(*(np.concatenate(x) for x in zip(*kept, strict=True)))

    own = F.shiftrightunsigned("fp", free)
    routed = (
        distinct.select("fp", F.explode(F.array(*[F.lit(p) for p in prefixes])).alias("flips"))
        .select(own.bitwiseXOR(F.col("flips")).cast("int").alias("prefix"), "fp")
        .repartition("prefix")
        .sortWithinPartitions("prefix")
    )
    return routed.mapInArrow(link, "a long, b long").distinct()


def simhash_groups(
    docs: DataFrame, words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, prefix_bits: int | None = None
) -> DataFrame:
    """(doc_id, fingerprint, component_id, row_key, keep) per input row.

    ``component_id`` is the smallest doc_id reachable over links of at most ``max_bits`` differing bits
    (NULL where the whole group has no id). ``keep`` marks the one row key of each group that stays:
    the smallest id, then the smallest row key. Empty and NULL texts have fingerprint zero and are
    linked like any other; repeated rows share a row key. An empty table gives an empty result.
    ``prefix_bits`` follows the number of distinct fingerprints if not given; it sets memory, not results."""
    rows = materialise(fingerprints(docs, words))
    if prefix_bits is None:
        prefix_bits = prefix_bits_for(rows.agg(F.approx_count_distinct("fp").alias("n")).first().n, max_bits)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key")).alias("first")
    by_fp = rows.groupBy("fp").agg(first)
    roots = star_components(near_links(rows.select("fp").distinct(), max_bits, prefix_bits))
    rooted = by_fp.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "first"
    )
    groups = rooted.groupBy("root").agg(F.min("first").alias("first"))
    of_fp = rooted.select("fp", "root").join(groups, "root").select("fp", "first")
    return rows.join(of_fp, "fp").select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("first.doc_id").alias("component_id"),
        "row_key",
        (F.col("row_key") == F.col("first.row_key")).alias("keep"),
    )


def drop_near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """The columns of ``docs``; one row of each SimHash group stays (see :func:`simhash_groups`)."""
    keep = simhash_groups(docs, words, max_bits).where("keep").select(F.col("row_key").alias("k")).distinct()
    keyed = docs.select(F.struct("*").alias("d"), row_key(F.col("doc_id"), F.col("text")).alias("k"))
    return keyed.join(keep, "k").dropDuplicates(["k"]).select("d.*")
