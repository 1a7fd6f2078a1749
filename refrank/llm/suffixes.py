"""Exact removal of repeated byte strings with a logarithmic family of suffix arrays.

A byte is removed when a ``LENGTH``-byte string that covers it also starts in a document with a smaller
doc_id. Every such string (window) has a key that depends on its bytes alone: the smallest hash among its
``GRAM``-byte grams. Neighbouring windows mostly share their key, so a run of them travels as one record of
at most ``WIDTH`` bytes, and equal windows of any two documents meet in the bucket of their key.

1. A scan ships the keys alone, as sorted packed blobs; keys that two documents have set bits of a filter
   of fixed size. The filter only spares work: a record that passes wrongly is compared and found unique.
2. A second scan ships the records that pass. A record whose bytes a smaller document has in the same part
   of the scan is a repeat there and then: its span is sent on and only the smallest document's record
   goes to the bucket. A key with very many records is hot (bits of a second fixed filter): its windows
   travel one by one, each by the hash of all its bytes, so different contexts of a common gram spread over
   all buckets. Each bucket takes its windows in document order, in batches:
   a batch gets its suffix array (windows are suffixes, compared on ``LENGTH`` bytes), is merge-scanned
   against every existing level, then becomes a level itself, and levels of equal rank merge, as the digits
   of a binary counter carry. A window found in a level, or after a smaller document in its own batch, is
   a repeat.
3. Covered spans go back to their documents, packed by document partition, and are cut there.

Records that are the same bytes are merged where they are made and again in the bucket, so a passage that
a third of all documents share reaches its bucket once per part of the scan, not once per document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refrank.llm.base import LONG_MAX, materialise
from refrank.operators.ranking import global_row_number

LENGTH = 50
GRAM = 16
SPAN = LENGTH - GRAM + 1  # grams in a window; the most windows in a record
WIDTH = 88  # bytes kept for a record: SPAN - 1 + LENGTH, rounded up to whole 64-bit words
FILTER_BITS = 1 << 27  # of the shared-key filter, whatever the input's size: 16 MB
SEGMENT_BITS = 1 << 18  # of a filter, put together in one task
BATCH_WINDOWS = 1 << 17  # windows in a new batch of the index family
SLICE_BYTES = 1 << 20  # text hashed at a time in a task
FLUSH_BYTES = 8 << 20  # text per set of blobs
BUCKET_BYTES = 4 << 20  # text per bucket
LEAST_BUCKETS = 256
HOT_RECORDS = 1 << 15  # records of one key that make it hot, at least
HOT_PER_PART = 4  # and so many per part of the scan (FLUSH_BYTES of text)
CHUNK_RECORDS = 1 << 19  # records packed at a time

# Odd multipliers for mixing 64-bit words.
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def _mixed(x: np.ndarray, by: int) -> np.ndarray:
    x = x * MIX[by]
    x ^= x >> np.uint64(32)
    return x


def window_keys(data: np.ndarray) -> np.ndarray:
    """Key of the window at each position of ``data`` (uint8): the smallest mixed gram in it."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ascontiguousarray(sliding_window_view(padded, 8)).view("<u8")[:, 0]
    n = len(data) - GRAM + 1
    h = words[:n] * MIX[0]
    h ^= _mixed(words[8 : 8 + n], 1)
    h ^= h >> np.uint64(29)
    h = _mixed(h, 2)
    size = 1
    while 2 * size <= SPAN:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    if size < SPAN:
        h = np.minimum(h[: len(h) - (SPAN - size)], h[SPAN - size :])
    return h


def _slices(offsets: np.ndarray) -> Iterator[list[tuple[int, int, int]]]:
    """Groups of (document index, first byte, last byte) of about SLICE_BYTES; a long text is cut into
    parts that overlap by one window less a byte, so each window is in exactly one part."""
    group, size = [], 0
    for d in range(len(offsets) - 1):
        a, z = int(offsets[d]), int(offsets[d + 1])
        while z - a >= LENGTH:
            end = min(z, a + SLICE_BYTES + LENGTH - 1)
            group.append((d, a, end))
            size += end - a
            a = end - LENGTH + 1 if end < z else z
            if size >= SLICE_BYTES:
                yield group
                group, size = [], 0
    if group:
        yield group


def _runs(data: np.ndarray, group: list[tuple[int, int, int]]):
    """(key, start, count, document) of the runs of equally keyed windows of a group of slices."""
    lo, hi = group[0][1], group[-1][2]
    keys = window_keys(data[lo:hi])
    a = np.array([g[1] for g in group]) - lo
    n = np.array([g[2] - g[1] for g in group]) - LENGTH + 1
    doc = np.repeat(np.array([g[0] for g in group]), n)
    first = np.cumsum(n) - n
    at = np.arange(len(doc)) + np.repeat(a - first, n)
    key = keys[at]
    cut = np.concatenate(([True], key[1:] != key[:-1]))
    cut[first] = True
    begin = np.flatnonzero(cut)
    length = np.diff(np.concatenate((begin, [len(key)])))
    parts = -(-length // SPAN)  # runs of periodic text are cut to the record width
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = np.repeat(begin, parts) + nth * SPAN
    count = np.minimum(np.repeat(length, parts) - nth * SPAN, SPAN)
    return key[begin], at[begin] + lo, count, doc[begin]


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((_mixed(key, 3) >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)


def _short(key: np.ndarray) -> np.ndarray:
    """40 bits of a key, apart from those that choose the bucket."""
    return _mixed(key ^ MIX[0], 1) & np.uint64((1 << 40) - 1)


def _filter_bit(short: np.ndarray, bits: int) -> np.ndarray:
    return (short % np.uint64(bits)).astype(np.int64)



def _pack(*columns: np.ndarray) -> bytes:
    """Columns as one compressed blob; wide numbers are stored byte plane by byte plane."""
    out = [np.array([len(columns)], "<i8").tobytes()]
    for c in columns:
        planes = np.ascontiguousarray(c).view(np.uint8).reshape(-1, c.itemsize).T
        out += [np.array([c.nbytes], "<i8").tobytes(), c.dtype.str.encode().ljust(8), np.ascontiguousarray(planes).tobytes()]
    return zstandard.compress(b"".join(out), 1)


def _unpack(blob: bytes) -> list[np.ndarray]:
    raw = memoryview(zstandard.decompress(blob))
    n, at, out = int.from_bytes(raw[:8], "little"), 8, []
    for _ in range(n):
        size, kind = int.from_bytes(raw[at : at + 8], "little"), np.dtype(bytes(raw[at + 8 : at + 16]).strip().decode())
        planes = np.frombuffer(raw[at + 16 : at + 16 + size], np.uint8).reshape(kind.itemsize, -1)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel())
        at += 16 + size
    return out


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Slices of a sorted bucket column."""
    cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True]))) if len(bucket) else []
    for a, z in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(bucket[a]), slice(a, z)


def _texts(b: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column of an Arrow batch, without a copy."""
    arr = b.column(column)
    _, off, data = arr.buffers()
    wide = np.int64 if pa.types.is_large_string(arr.type) else np.int32
    offsets = np.frombuffer(off, wide)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8), offsets


def _flushes(offsets: np.ndarray, data: np.ndarray):
    """Sets of runs of about FLUSH_BYTES of text."""
    held, size = [], 0
    for group in _slices(offsets):
        held.append(_runs(data, group))
        size += sum(g[2] - g[1] for g in group)
        if size >= FLUSH_BYTES:
            yield [np.concatenate(x) for x in zip(*held, strict=True)]
            held, size = [], 0
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _contexts(data: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """A number per record that tells its contexts apart: its first and last eight bytes."""
    eight = sliding_window_view(data, 8)
    head = np.ascontiguousarray(eight[start]).view("<u8").ravel()
    tail = np.ascontiguousarray(eight[start + count + LENGTH - 9]).view("<u8").ravel()
    return _mixed(head, 0) ^ _mixed(tail, 1)


def _key_blobs(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not b.num_rows:
            continue
        data, offsets = _texts(b, 2)
        ids = b.column(0).to_numpy()
        for key, start, count, doc in _flushes(offsets, data):
            bucket, short = _bucket(key, buckets), _short(key)
            order = np.lexsort((ids[doc], short, bucket))
            bucket, short, owner = bucket[order], short[order], ids[doc][order]
            first = np.concatenate(([True], (short[1:] != short[:-1]) | (bucket[1:] != bucket[:-1])))
            other = np.concatenate(([False], owner[1:] != owner[:-1])) & ~first
            # once per key; for a key that two documents of the flush have, once more for every
            # doubling of its different contexts
            run = np.cumsum(first) - 1
            shared = np.zeros(run[-1] + 1, np.int64)
            np.maximum.at(shared, run[other], 1)
            several = shared[run] == 1
            of, contexts = run[several], _contexts(data, start[order][several], count[order][several])
            by = np.lexsort((contexts, of))
            of, contexts = of[by], contexts[by]
            again = np.concatenate(([False], (of[1:] == of[:-1]) & (contexts[1:] == contexts[:-1])))[: len(of)]
            n = np.bincount(of[~again], minlength=len(shared))
            shared *= np.maximum(1, np.log2(np.maximum(n, 1)).astype(np.int64))
            bucket, short = np.repeat(bucket[first], 1 + shared), np.repeat(short[first], 1 + shared)
            rows = [(k, _pack(np.diff(short[s], prepend=np.uint64(0)))) for k, s in _by_bucket(bucket)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "blob"])


def _shared_bits(table: pa.Table, bits: int, hot: int) -> pa.Table:
    """Filter bits of the keys of a bucket that two documents may have, and of its hot keys, as sorted
    positions. A key that a blob has ``1 + k`` times stands for about ``2**k`` records."""
    keys, records = [], []
    for x in table.column("blob"):
        key, times = np.unique(np.cumsum(_unpack(x.as_py())[0], dtype=np.uint64), return_counts=True)
        keys.append(key)
        records.append(np.int64(1) << (times - 1))
    key, records = np.concatenate(keys), np.concatenate(records)
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    total = np.add.reduceat(records[order], first)
    at = [_pack(np.diff(np.unique(_filter_bit(key[first][total >= n], bits)), prepend=0)) for n in (2, hot)]
    return pa.table({"shared": pa.array(at[:1], pa.binary()), "hot": pa.array(at[1:], pa.binary())})


def _by_segment(batches: Iterator[pa.RecordBatch], size: int, segments: int) -> Iterator[pa.RecordBatch]:
    """(segment, blob): the positions of each bucket within each segment of the shared and the hot filter."""
    for b in batches:
        segment, blob = [], []
        for field, column in enumerate(b.columns):
            for x in column:
                at = np.cumsum(_unpack(x.as_py())[0]).astype(np.int64)
                for n, rows in _by_bucket(at // size):
                    segment.append(field * segments + n)
                    blob.append(_pack((at[rows] - n * size).astype(np.uint32)))
        yield pa.RecordBatch.from_arrays([pa.array(segment, pa.int32()), pa.array(blob, pa.binary())], ["segment", "blob"])


def _segments(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """(segment, blob): each segment's bits, as one compressed blob; a task holds its segments, no positions."""
    made: dict[int, np.ndarray] = {}
    for b in batches:
        for n, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            at = _unpack(x.as_py())[0]
            np.bitwise_or.at(made.setdefault(n, np.zeros(size // 8, np.uint8)), at >> 3, (1 << (at & 7)).astype(np.uint8))
    for n, field in made.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([n], pa.int32()), pa.array([zstandard.compress(field.tobytes(), 1)], pa.binary())], ["segment", "blob"]
        )


def _filters(bits: DataFrame, filter_bits: int) -> np.ndarray:
    """The shared and the hot filter, from the buckets' packed positions. Segments are put together on
    Spark; what comes to the driver is the two filters themselves, whatever the number of shared keys."""
    size = min(SEGMENT_BITS, filter_bits)
    segments = -(-filter_bits // size)
    dense = (
        bits.mapInArrow(lambda it: _by_segment(it, size, segments), "segment int, blob binary")
        .repartition("segment")
        .mapInArrow(lambda it: _segments(it, size), "segment int, blob binary")
    )
    fields = np.zeros((2 * segments, size // 8), np.uint8)
    for row in dense.collect():  # at most 2 * segments rows
        fields[row.segment] = np.frombuffer(zstandard.decompress(bytes(row.blob)), np.uint8)
    return fields.reshape(2, -1)[:, : filter_bits // 8]


def _row_hash(rows: np.ndarray) -> np.ndarray:
    words = rows.view("<u8")
    h = np.zeros(len(rows), np.uint64)
    for k in range(words.shape[1]):
        h = _mixed(h ^ words[:, k], k % 4)
    return h


def _merge_equal(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of a representative per distinct row, class of each row); rows are compared byte by byte."""
    words, h = rows.view("<u8"), _row_hash(rows)
    order = np.argsort(h, kind="stable")
    same = np.concatenate(([False], (h[order][1:] == h[order][:-1]) & (words[order][1:] == words[order][:-1]).all(axis=1)))
    classes = np.empty(len(rows), np.int64)
    classes[order] = np.cumsum(~same) - 1
    return order[~same], classes


_TAIL = np.where(np.arange(WIDTH)[None, :] < (np.arange(SPAN + 1) + LENGTH - 1)[:, None], 255, 0).astype(np.uint8)


def _bit_set(field: np.ndarray, bit: np.ndarray) -> np.ndarray:
    return (field[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1


def _packed_spans(ids: np.ndarray, tags: np.ndarray, start: np.ndarray, size: np.ndarray, partitions: int):
    """(document partition, blob) of spans of at most 255 bytes."""
    where = tags.astype(np.int64) % partitions
    order = np.lexsort((start, tags, where))
    where, ids, tags, start, size = where[order], ids[order], tags[order], start[order], size[order]
    for p, s in _by_bucket(where):
        yield p, _pack(ids[s], tags[s], start[s].astype(np.int32), size[s].astype(np.uint8))


def _record_blobs(batches: Iterator[pa.RecordBatch], buckets: int, passing: np.ndarray, heavy: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """(bucket, NULL, records) for the buckets to compare, and (partition, partition, spans) of repeats that
    are already found."""
    for b in batches:
        if not b.num_rows:
            continue
        data, offsets = _texts(b, 2)
        ids, tags = b.column(0).to_numpy(), b.column(1).to_numpy()
        padded = np.concatenate([data[: offsets[-1]], np.zeros(WIDTH, np.uint8)])
        view = sliding_window_view(padded, WIDTH)
        for key, start, count, doc in _flushes(offsets, data):
            bit = _filter_bit(_short(key), bits)
            ok = _bit_set(passing, bit)
            key, start, count, doc, hot = key[ok], start[ok], count[ok], doc[ok], _bit_set(heavy, bit[ok])
            upto = np.cumsum(np.where(hot, count, 1))
            a = 0
            while a < len(key):
                z = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + CHUNK_RECORDS, side="right")))
                part = slice(a, z)
                yield _chunk_blobs(view, offsets, ids, tags, key[part], start[part], count[part], doc[part], hot[part], buckets)
                a = z


def _chunk_blobs(view, offsets, ids, tags, key, start, count, doc, hot, buckets: int) -> pa.RecordBatch:
    n = np.where(hot, count, 1)  # a hot run is taken apart into its windows
    run = np.repeat(np.arange(len(key)), n)
    start = start[run] + np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
    key, doc, hot, count = key[run], doc[run], hot[run], np.where(hot, 1, count)[run]
    rows = view[start] & _TAIL[count]
    key[hot] = _row_hash(np.ascontiguousarray(rows[hot]))
    start = start - offsets[doc]
    one, classes = _merge_equal(rows)
    least = np.full(len(one), LONG_MAX, np.int64)
    np.minimum.at(least, classes, ids[doc])
    found = ids[doc] > least[classes]
    # found windows of one run are one span
    joined = found[1:] & found[:-1] & (run[1:] == run[:-1])
    lead, last = found & ~np.concatenate(([False], joined)), found & ~np.concatenate((joined, [False]))
    size = start[last] + count[last] + LENGTH - 1 - start[lead]
    spans = list(_packed_spans(ids[doc[lead]], tags[doc[lead]], start[lead], size, buckets))
    bucket = _bucket(key[one], buckets)
    by = np.lexsort((_short(key[one]), bucket))  # distinct records, by bucket and key
    place = np.empty(len(by), np.int64)
    place[by] = np.arange(len(by))
    one, bucket = one[by], bucket[by]
    left = np.flatnonzero(~found)
    nth = place[classes[left]]
    members = np.argsort(nth, kind="stable")
    nth, where, doc = nth[members], start[left][members], doc[left][members]
    blobs, names = [], []
    for k, s in _by_bucket(bucket):
        m = slice(*np.searchsorted(nth, [s.start, s.stop]))
        short = _short(key[one[s]])
        blobs.append(
            _pack(
                rows[one[s]].reshape(-1), count[one[s]].astype(np.uint8), np.diff(short, prepend=np.uint64(0)),
                np.diff(nth[m], prepend=s.start).astype(np.uint8) if len(nth[m]) else np.empty(0, np.uint8),
                ids[doc[m]], tags[doc[m]], where[m].astype(np.int32),
            )
        )
        names.append(k)
    parts = [p for p, _ in spans]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(names + parts, pa.int32()),
            pa.array([None] * len(names) + parts, pa.int32()),
            pa.array(blobs + [x for _, x in spans], pa.binary()),
        ],
        ["bucket", "part", "blob"],
    )


class IndexFamily:
    """Suffix arrays whose sizes grow geometrically: level ``k`` holds the new windows of 2**k batches."""

    def __init__(self):
        self.levels: list[tuple[int, np.ndarray]] = []

    def add(self, windows: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Which windows of a batch repeat one of a smaller document. ``doc`` ascends and is above every
        document of the batches before."""
        order = np.argsort(windows, kind="stable")
        array = windows[order]
        first = np.concatenate(([True], array[1:] != array[:-1]))
        head = order[first]
        known = np.zeros(len(head), bool)
        for _, level in self.levels:  # merge-scan: both sides are sorted
            at = np.minimum(np.searchsorted(level, array[first]), len(level) - 1)
            known |= level[at] == array[first]
        run = np.cumsum(first) - 1
        repeat = np.empty(len(windows), bool)
        repeat[order] = known[run] | (doc[order] > doc[head][run])
        rank, merged = 0, array[first][~known]
        while self.levels and self.levels[-1][0] == rank:
            merged = np.sort(np.concatenate([self.levels.pop()[1], merged]), kind="stable")
            rank += 1
        if len(merged):
            self.levels.append((rank, merged))
        return repeat


def _repeats(rows: np.ndarray, count: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(flat repeat flags, first flag of each record) for records in ascending order of ``doc``."""
    begin = np.cumsum(count) - count
    flags = np.zeros(int(count.sum()), bool)
    flat = sliding_window_view(np.concatenate([rows.reshape(-1), np.zeros(LENGTH, np.uint8)]), LENGTH)
    family, a = IndexFamily(), 0
    while a < len(rows):
        z = int(np.searchsorted(begin, begin[a] + BATCH_WINDOWS))
        z = min(max(z, a + 1), len(rows))
        z = int(np.searchsorted(doc, doc[z - 1], side="right"))  # a batch ends with a document
        n = count[a:z]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        windows = np.ascontiguousarray(flat[np.repeat(np.arange(a, z), n) * WIDTH + within]).view(f"S{LENGTH}").ravel()
        flags[begin[a] : begin[a] + len(within)] = family.add(windows, np.repeat(doc[a:z], n))
        a = z
    return flags, begin


def _bucket_spans(table: pa.Table, partitions: int) -> pa.Table:
    """Covered spans of one bucket, packed by document partition, with those that came as spans."""
    ready = table.column("part").is_valid()
    passed = table.filter(ready).select(["part", "blob"])
    table = table.filter(pc.invert(ready))
    if not table.num_rows:
        return passed
    cols = [[] for _ in range(7)]
    base = 0
    for blob in table.column("blob"):
        rows, count, short, nth, ids, tags, start = _unpack(blob.as_py())
        for c, x in zip(cols, (rows.reshape(-1, WIDTH), count.astype(np.int64), np.cumsum(short, dtype=np.uint64), np.cumsum(nth, dtype=np.int64) + base, ids, tags, start), strict=True):
            c.append(x)
        base += len(count)
    rows, count, short, nth, ids, tags, start = (np.concatenate(c) for c in cols)
    one, classes = _merge_equal(np.ascontiguousarray(rows))
    rows, count, short, nth = rows[one], count[one], short[one], classes[nth]
    least = np.full(len(rows), LONG_MAX, np.int64)
    np.minimum.at(least, nth, ids)
    _, group, size = np.unique(short, return_inverse=True, return_counts=True)
    several = np.flatnonzero(size[group] > 1)  # a record alone with its key has no partial match
    several = several[np.argsort(least[several], kind="stable")]
    flags, begin = _repeats(rows[several], count[several], least[several])
    # runs of repeated windows of the records' first documents, in record order
    owner = np.repeat(several, count[several])
    offset = np.arange(len(flags)) - np.repeat(begin, count[several])
    start_run = flags & ~np.concatenate(([False], flags[:-1] & (owner[1:] == owner[:-1]))) if len(flags) else flags
    end_run = flags & ~np.concatenate((flags[1:] & (owner[1:] == owner[:-1]), [False])) if len(flags) else flags
    run_of, run_a, run_z = owner[start_run], offset[start_run], offset[end_run]
    by = np.argsort(run_of, kind="stable")
    run_of, run_a, run_z = run_of[by], run_a[by], run_z[by]
    later = ids > least[nth]
    whole = np.stack([start[later], start[later] + count[nth[later]] + LENGTH - 1], axis=1)
    first = np.flatnonzero(~later)
    lo, hi = np.searchsorted(run_of, nth[first]), np.searchsorted(run_of, nth[first], side="right")
    n = hi - lo
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
    who = np.repeat(first, n)
    part = np.stack([start[who] + run_a[k], start[who] + run_z[k] + LENGTH], axis=1)
    spans = np.concatenate([whole, part]).astype(np.int32)
    member = np.concatenate([np.flatnonzero(later), who])
    made = list(_packed_spans(ids[member], tags[member], spans[:, 0], spans[:, 1] - spans[:, 0], partitions))
    found = pa.table({"part": pa.array([p for p, _ in made], pa.int32()), "blob": pa.array([x for _, x in made], pa.binary())})
    return pa.concat_tables([passed.cast(found.schema), found])


def _merge_spans(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of sorted half-open spans; touching spans are one run."""
    reach = np.maximum.accumulate(stop)
    cut = np.concatenate(([True], start[1:] > reach[:-1]))
    return start[cut], reach[np.concatenate((np.flatnonzero(cut)[1:] - 1, [len(start) - 1]))]


def _cut(docs: pa.Table, found: pa.Table) -> pa.Table:
    blobs = [_unpack(x.as_py()) for x in found.column("blob")] if found.num_rows else []
    if blobs:
        ids, tags, start, size = (np.concatenate(c) for c in zip(*blobs, strict=True))
        order = np.lexsort((start, ids, tags))
        ids, tags, start, size = ids[order], tags[order], start[order].astype(np.int64), size[order]
    else:
        ids = tags = start = size = np.empty(0, np.int64)
    n_bytes, gone, runs, kept, spans = [], [], [], [], []
    for rank, tag, text in zip(docs.column("rank").to_pylist(), docs.column("tag").to_pylist(), docs.column("text"), strict=True):
        raw = text.as_buffer()
        raw = raw.to_pybytes() if raw is not None else b""
        a, z = np.searchsorted(tags, [tag, tag + 1])
        a, z = a + np.searchsorted(ids[a:z], [rank, rank], side="left")[0], a + np.searchsorted(ids[a:z], rank, side="right")
        digest, at = hashlib.sha256(), 0
        if z > a:
            lo, hi = _merge_spans(start[a:z], start[a:z] + size[a:z])
            for x, y in zip(lo.tolist(), hi.tolist(), strict=True):
                digest.update(raw[at:x])
                at = y
        else:
            lo = hi = np.empty(0, np.int64)
        digest.update(raw[at:])
        n_bytes.append(len(raw))
        gone.append(int((hi - lo).sum()))
        runs.append(len(lo))
        kept.append(digest.hexdigest())
        spans.append([{"start": x, "stop": y} for x, y in zip(lo.tolist(), hi.tolist(), strict=True)])
    return pa.table(
        {
            "doc_id": docs.column("doc_id"), "n_bytes": pa.array(n_bytes, pa.int64()), "n_removed": pa.array(gone, pa.int64()),
            "n_spans": pa.array(runs, pa.int64()), "kept_sha256": pa.array(kept, pa.string()),
            "removed": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
        }
    )


def _tagged(rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, rank, text) with ``tag``: 31 bits of a hash, and a number of their own below zero for different
    texts of one rank (a NULL or repeated doc_id) whose hashes collide. Equal rows share a tag."""
    hashed = rows.withColumn("tag", F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 33).cast("int"))
    hashed = hashed.withColumn("key", F.md5("text"))
    sides = hashed.groupBy("rank", "tag").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    clash = materialise(sides.where("low <> high").select("rank", "tag"))
    if not clash.limit(1).count():
        return hashed.drop("key")
    texts = hashed.select("rank", "tag", "key").join(clash, ["rank", "tag"]).distinct()
    own = global_row_number(texts, ["rank", "tag", "key"], "nth").select("rank", "tag", "key", (-F.col("nth")).cast("int").alias("own"))
    tag = F.coalesce("own", "tag").alias("tag")
    return hashed.join(materialise(own), ["rank", "tag", "key"], "left").select("doc_id", "rank", "text", tag)


def repeated_bytes(
    docs: DataFrame, filter_bits: int = FILTER_BITS, bucket_bytes: int = BUCKET_BYTES, hot_records: int = HOT_RECORDS
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed array<struct<start, stop>>) per input row.

    Texts are UTF-8 bytes, NULL as empty; offsets are bytes of the original text, half open. Rows with one
    doc_id do not remove each other's bytes; a NULL doc_id comes after every id. Texts shorter than a
    window keep all their bytes. An empty table gives an empty result. ``filter_bits``,
    ``bucket_bytes`` and ``hot_records`` set memory, not results."""
    spark = docs.sparkSession
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LONG_MAX)).alias("rank"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    rows = _tagged(rows)
    total = rows.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    buckets = max(LEAST_BUCKETS, total // bucket_bytes)
    hot = max(hot_records, HOT_PER_PART * (total // FLUSH_BYTES))
    scan = rows.select("rank", "tag", "text")

    keys = scan.mapInArrow(lambda it: _key_blobs(it, buckets), "bucket int, blob binary")
    bits = keys.groupBy("bucket").applyInArrow(lambda t: _shared_bits(t, filter_bits, hot), "shared binary, hot binary")
    fields = _filters(bits, filter_bits)
    shared = spark.sparkContext.broadcast(zstandard.compress(fields.tobytes(), 1))

    def records(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passing, heavy = np.frombuffer(zstandard.decompress(shared.value), np.uint8).reshape(2, -1)
        return _record_blobs(it, buckets, passing, heavy, filter_bits)

    spans = (
        scan.mapInArrow(records, "bucket int, part int, blob binary")
        .groupBy("bucket")
        .applyInArrow(lambda t: _bucket_spans(t, buckets), "part int, blob binary")
    )
    placed = rows.select("doc_id", "rank", "tag", "text", F.pmod("tag", F.lit(buckets)).cast("int").alias("part"))
    schema = (
        "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
        "removed array<struct<start:long,stop:long>>"
    )
    return placed.groupBy("part").cogroup(spans.groupBy("part")).applyInArrow(_cut, schema)
