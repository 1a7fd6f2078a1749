"""Ranked lexical search by pipelined term partitioning.

Documents are dealt into shards of about ``SHARD_ROWS`` rows. The terms of the items are dealt to ``OWNERS``
owners, from the rarest terms to the most frequent ones, so that every owner has about as many postings. For
each (shard, owner) there is one row of postings with the integer contribution of every (term, document).

A bundle is one item in one shard: its terms and a sparse accumulator of documents and scores. Bundles go
through the owners one after another. Each stage is a cogroup of the bundles with the postings of that owner
in the same shard; it adds the contributions and sends the bundle on. A document is dropped from an accumulator only
when its score and all that later owners could still add stay below the score that ``k`` documents of the
shard have already, which no final selection can undo. The last stage takes the ``k`` first of each bundle;
the final selection merges the shards.

A task holds one shard's postings of one owner and the bundles of at most ``BUNDLE_ITEMS`` items, however
many documents there are or hold a term.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from refrank.llm.base import id_text, materialise

K = 20
OWNERS = 4
SHARD_ROWS = 8192
BUNDLE_ITEMS = 256
BLOCK_ITEMS = 16_384  # items, and different terms of them, that one pass over the documents serves
BLOCK_TERMS = 1 << 20
UNIT = 10**9

# Letters and digits stay, A-Z in lower case, like every byte of a character beyond ASCII; the rest are blanks.
TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)

RESULT = "item_id long, rank int, doc_id long, score long"
BUNDLE = "shard int, part int, item int, terms array<int>, times array<int>, slots array<int>, scores array<bigint>"
POSTINGS = "shard int, owner int, terms array<int>, starts array<int>, slots array<int>, parts array<bigint>, ids array<bigint>"


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text in order: maximal runs of letters, digits and characters beyond ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(TABLE).split()


@dataclass
class Block:
    """Items that share a pass over the documents; at most ``BLOCK_TERMS`` terms unless one item alone has more."""

    ids: list[int | None]
    words: dict[bytes, int]  # term -> number
    terms: list[np.ndarray]  # of each item
    times: list[np.ndarray]


def blocks_of(items: DataFrame, most_items: int = BLOCK_ITEMS, most_terms: int = BLOCK_TERMS) -> Iterator[Block]:
    """Read the items in order, holding one block at a time on the driver."""
    block = Block([], {}, [], [])
    rows = items.select(F.col("item_id").cast("bigint").alias("i"), F.col("text").cast("string").alias("t"))
    for r in rows.toLocalIterator():
        found = terms_of(r.t)
        if block.ids and (len(block.ids) >= most_items or len(block.words) + len(found) > most_terms):
            yield block
            block = Block([], {}, [], [])
        numbers = np.array([block.words.setdefault(w, len(block.words)) for w in found], np.int32)
        different, times = np.unique(numbers, return_counts=True)
        block.ids.append(r.i)
        block.terms.append(different)
        block.times.append(times.astype(np.int32))
    if block.ids:
        yield block


def count_terms(docs: DataFrame, words: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs) of every document with a term: its length and its counts of the terms in ``words``."""
    shared = docs.sparkSession.sparkContext.broadcast(words)  # bounded by BLOCK_TERMS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shared.value.get
        for b in batches:
            keep, n, offsets, terms, tfs = [], [], [0], [], []
            for k, t in enumerate(b.column(1).to_pylist()):
                found = terms_of(t)
                if found:
                    numbers = np.fromiter(map(get, found, repeat(-1)), np.int32, len(found))
                    different, times = np.unique(numbers[numbers >= 0], return_counts=True)
                    keep.append(k)
                    n.append(len(found))
                    terms.append(different)
                    tfs.append(times.astype(np.int32))
                    offsets.append(offsets[-1] + len(different))
            if keep:
                at = pa.array(offsets, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).take(pa.array(keep)),
                        pa.array(n, pa.int64()),
                        pa.ListArray.from_arrays(at, pa.array(np.concatenate(terms))),
                        pa.ListArray.from_arrays(at, pa.array(np.concatenate(tfs))),
                    ],
                    ["doc_id", "n", "terms", "tfs"],
                )

    return id_text(docs).mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


def term_statistics(counted: DataFrame, terms: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents of each term and its highest count in one; each partition sends one line per term it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, most = np.zeros(terms, np.int64), np.zeros(terms, np.int32)
        for b in batches:
            numbers = b.column(0).flatten().to_numpy()
            df += np.bincount(numbers, minlength=terms)
            np.maximum.at(most, numbers, b.column(1).flatten().to_numpy())
        has = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array(has.astype(np.int32)), pa.array(df[has]), pa.array(most[has])], ["term", "df", "most"]
        )

    lines = counted.select("terms", "tfs").mapInArrow(run, "term int, df long, most int")
    df, most = np.zeros(terms, np.int64), np.zeros(terms, np.int64)
    for r in lines.groupBy("term").agg(F.sum("df").alias("df"), F.max("most").alias("most")).collect():
        df[r.term], most[r.term] = r.df, r.most
    return df, most


def owners_of(df: np.ndarray, owners: int) -> np.ndarray:
    """Owner of each term: rare terms first, about as many postings for every owner."""
    order = np.argsort(df, kind="stable")
    before = np.cumsum(df[order]) - df[order]
    out = np.empty(len(df), np.int32)
    out[order] = np.minimum(owners - 1, before * owners // max(1, int(df.sum())))
    return out


def inverted(counted: DataFrame, shards: int, weight: np.ndarray, owner: np.ndarray, n_docs: int, length: int, owners: int) -> DataFrame:
    """One row of postings per (shard, owner), and a row with the shard's doc_ids under owner ``owners``.

    Slots number the documents of a shard by doc_id (NULL last), so smaller slots win ties."""
    shared = counted.sparkSession.sparkContext.broadcast((weight, owner))

    def invert(group: pa.Table) -> pa.Table:
        weight, owner = shared.value
        group = group.sort_by([("doc_id", "ascending")]).combine_chunks()  # NULL last
        shard = group["shard"][0].as_py()
        n = group["n"].to_numpy()
        m = 75 + (25 * n * n_docs) // length
        lists = group["terms"].chunk(0)
        slots = np.repeat(np.arange(len(n), dtype=np.int32), np.diff(lists.offsets.to_numpy()))
        terms, tf = lists.flatten().to_numpy(), group["tfs"].chunk(0).flatten().to_numpy().astype(np.int64)
        parts = weight[terms] * ((UNIT * tf) // (1000 * tf + 12 * m[slots]))
        order = np.lexsort((slots, terms, owner[terms]))
        order = order[parts[order] > 0]
        terms, slots, parts = terms[order], slots[order], parts[order]
        own = owner[terms]
        rows = []
        for o in np.unique(own).tolist():
            a, z = np.searchsorted(own, [o, o + 1])
            different, starts = np.unique(terms[a:z], return_index=True)
            rows.append((shard, o, different, np.append(starts, z - a).astype(np.int32), slots[a:z], parts[a:z], None))
        none, longs = np.empty(0, np.int32), np.empty(0, np.int64)
        rows.append((shard, owners, none, none, none, longs, group["doc_id"].to_pylist()))
        types = (pa.int32(), pa.int32(), *[pa.list_(pa.int32())] * 3, *[pa.list_(pa.int64())] * 2)
        names = ["shard", "owner", "terms", "starts", "slots", "parts", "ids"]
        return pa.table([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    dealt = counted.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInArrow(invert, POSTINGS)


def _values(table: pa.Table, name: str) -> list[np.ndarray]:
    """One numpy array per row of a list column."""
    chunk = table[name].combine_chunks()
    if isinstance(chunk, pa.ChunkedArray):
        chunk = chunk.chunk(0)
    flat, at = chunk.flatten().to_numpy(), chunk.offsets.to_numpy()
    at = at - at[0]
    return [flat[a:z] for a, z in zip(at[:-1], at[1:], strict=True)]


def add_stage(bundles: pa.Table, postings: pa.Table, bound: np.ndarray, owner: np.ndarray, own: int, k: int) -> pa.Table:
    """The bundles with the contributions of owner ``own`` added."""
    if not bundles.num_rows:
        return bundles
    terms, times, slots, scores = (_values(bundles, c) for c in ("terms", "times", "slots", "scores"))
    where: dict[int, int] = {}
    if postings.num_rows:
        held, starts, places, parts = (_values(postings, c)[0] for c in ("terms", "starts", "slots", "parts"))
        where = {t: i for i, t in enumerate(held.tolist())}
    size = 1 + max([int(s.max()) for s in slots if len(s)] + ([int(places.max())] if where else [-1]))
    total = np.zeros(size, np.int64)
    for i in range(len(terms)):
        total[:] = 0
        total[slots[i]] = scores[i]
        for t, c in zip(terms[i].tolist(), times[i].tolist(), strict=True):
            at = where.get(t)
            if at is not None:
                a, z = starts[at], starts[at + 1]
                total[places[a:z]] += c * parts[a:z]
        left = np.flatnonzero(total)
        if len(left) > k:
            later = owner[terms[i]] > own
            rest = int((times[i][later] * bound[terms[i][later]]).sum())
            reached = np.partition(total[left], -k)[-k]
            left = left[total[left] + rest >= reached]
        slots[i], scores[i] = left.astype(np.int32), total[left]
    for name, value, kind in (("slots", slots, pa.int32()), ("scores", scores, pa.int64())):
        bundles = bundles.set_column(bundles.schema.get_field_index(name), name, pa.array(value, pa.list_(kind)))
    return bundles


def select_stage(bundles: pa.Table, ids: pa.Table, k: int) -> pa.Table:
    """(shard, slot, item, doc_id, score): the ``k`` first documents of each bundle."""
    item, slot, doc, score = [], [], [], []
    if bundles.num_rows and ids.num_rows:
        names = ids["ids"].combine_chunks()
        names = (names.chunk(0) if isinstance(names, pa.ChunkedArray) else names).flatten()
        for i, slots, scores in zip(bundles["item"].to_pylist(), _values(bundles, "slots"), _values(bundles, "scores"), strict=True):
            best = np.lexsort((slots, -scores))[:k]
            item += [i] * len(best)
            slot.append(slots[best])
            doc += names.take(pa.array(slots[best])).to_pylist()
            score.append(scores[best])
    shard = bundles["shard"][0].as_py() if bundles.num_rows else 0
    return pa.table(
        {
            "item": pa.array(item, pa.int32()),
            "shard": pa.array([shard] * len(item), pa.int32()),
            "slot": pa.array(np.concatenate(slot) if slot else [], pa.int32()),
            "doc_id": pa.array(doc, pa.int64()),
            "score": pa.array(np.concatenate(score) if score else [], pa.int64()),
        }
    )


def search_block(docs: DataFrame, block: Block, k: int, owners: int, shard_rows: int) -> DataFrame:
    """(item, rank, doc_id, score) of one block of items."""
    spark = docs.sparkSession
    counted = materialise(count_terms(docs, block.words).withColumn("row", F.monotonically_increasing_id()))
    seen = counted.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("length")).first()
    if not seen.docs or not block.words:
        return spark.createDataFrame([], RESULT.replace("item_id long", "item int"))
    df, most = term_statistics(counted, len(block.words))
    weight = np.array([math.floor(1000 * math.log((2 * seen.docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    weight[df == 0] = 0
    bound = weight * ((UNIT * most) // np.maximum(1, 1000 * most + 12 * 75))  # m is 75 at least
    owner = owners_of(df, owners)
    shards = max(1, -(-seen.docs // shard_rows))
    postings = materialise(inverted(counted, shards, weight, owner, seen.docs, seen.length, owners))
    shared = spark.sparkContext.broadcast((block.terms, block.times))  # bounded by the block

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, times = shared.value
        n = len(terms)
        for b in batches:
            for shard in b.column(0).to_pylist():
                for at in range(0, n, BUNDLE_ITEMS):
                    some = range(at, min(n, at + BUNDLE_ITEMS))
                    yield pa.RecordBatch.from_pydict(
                        {
                            "shard": pa.array([shard] * len(some), pa.int32()),
                            "part": pa.array([at // BUNDLE_ITEMS] * len(some), pa.int32()),
                            "item": pa.array(list(some), pa.int32()),
                            "terms": pa.array([terms[i] for i in some], pa.list_(pa.int32())),
                            "times": pa.array([times[i] for i in some], pa.list_(pa.int32())),
                            "slots": pa.array([[]] * len(some), pa.list_(pa.int32())),
                            "scores": pa.array([[]] * len(some), pa.list_(pa.int64())),
                        }
                    )

    parts = -(-len(block.ids) // BUNDLE_ITEMS)
    postings = postings.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    bundles = spark.range(0, shards, 1, max(1, min(shards, 2 * spark.sparkContext.defaultParallelism))).mapInArrow(start, BUNDLE)
    key = ["shard", "part"]
    limits = spark.sparkContext.broadcast((bound, owner))

    def stage(own: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
        return lambda left, right: add_stage(left, right, *limits.value, own, k)

    for own in range(owners):
        of_owner = postings.where(F.col("owner") == own).groupBy(key)
        bundles = bundles.groupBy(key).cogroup(of_owner).applyInArrow(stage(own), BUNDLE)
    best = bundles.groupBy(key).cogroup(postings.where(F.col("owner") == owners).groupBy(key)).applyInArrow(
        lambda left, right: select_stage(left, right, k), "item int, shard int, slot int, doc_id long, score long"
    )
    first = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "shard", "slot")
    return best.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k).select("item", "rank", "doc_id", "score")


def ranked_search(
    docs: DataFrame, items: DataFrame, k: int = K, owners: int = OWNERS, shard_rows: int = SHARD_ROWS, block_items: int = BLOCK_ITEMS
) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` highest-scoring documents of every item, score above 0.

    The score is the sum over the item's terms, repeats included, of w * (10^9 tf div (1000 tf + 12 m)) with
    w = floor(1000 ln((2 N + 2) / (2 df + 1))) and m = 75 + (25 n N) div L; ties by ascending doc_id, NULL last.

    Every row of ``items`` (item_id, text) is an item of its own, repeated rows and ids included, and every row
    of ``docs`` a document; documents without a term (NULL, empty or blank texts) count nowhere. Items without
    a term, or whose terms no document holds, return no row; empty tables give an empty result. Other columns
    are ignored. ``owners``, ``shard_rows`` and ``block_items`` set memory and passes, not results."""
    spark, out = docs.sparkSession, None
    for block in blocks_of(items, block_items):
        names = spark.createDataFrame(list(enumerate(block.ids)), "item int, item_id long")
        found = search_block(docs, block, k, owners, shard_rows)
        found = found.join(names, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        out = found if out is None else out.union(found)
    return spark.createDataFrame([], RESULT) if out is None else out
