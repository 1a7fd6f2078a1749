"""Benchmark passages in documents, under edits.

Texts are sequences of lower-cased words (of single characters for items that hold few blanks). An item of L
words is found where some stretch of a document is within ``floor(TOLERANCE * L)`` word edits of it.

* The CGK embedding walks a sequence with random bits: step j emits the current word and moves on if the bit
  of (j, word) is set. Two sequences at a small edit distance walk in step again after an edit with good odds, so
  their embeddings are close in Hamming distance. A walk over a whole item takes about 2 L steps; it starts
  at ``STARTS`` places of the item, so that edits at the front spoil some walks only.
* Bit-sampling LSH takes ``SAMPLED`` steps of an embedding as a signature. ``REPEATS`` independent walks, their
  samples drawn from the first steps of the walk, from more of them or from all in turn, reach the target
  recall; equal signatures of an item's walk and of a walk from a word of a document are candidates, and there are no others.
* By the q-gram lemma a match shares at least L - 1 - 2 d word pairs with the item. Stretches with fewer pairs of
  the benchmark are not walked, and candidates with fewer pairs of their item not verified; that loses nothing.
* Every candidate left is checked with the exact edit distance to the best stretch around it.

Items under ``MIN_WORDS`` words allow one edit at most; they are looked for in one piece or the other half.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refrank.llm.base import id_text, row_key

TOLERANCE = 0.2
MIN_WORDS = 8  # shorter items are searched exactly, by halves
SAMPLED = 3
REPEATS = 12
STARTS = 8
NEAR = 12  # steps; an edit that comes later does not spoil a sample
STEPS = 2  # of a walk, for each word of the shortest item of its class
BLOCK_ITEMS = 5000  # items searched for in one pass over the documents
BLOCK_WORDS = 1_000_000  # and their words, at most; together the bound of what is broadcast
SEED = 20240607
CHUNK = 1 << 20  # candidates, or words around them, looked at in one go
# Scripts written without blanks (Thai, Lao, Burmese, Khmer, kana, Han); each character is a word.
UNSPACED = r"\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
WORD = re.compile(rf"[{UNSPACED}]|[^\W{UNSPACED}]+")


def edits_allowed(n: int) -> int:
    return int(TOLERANCE * n + 1e-9)


def _last_row(item: list[int], words: list[int]) -> list[tuple[int, int]]:
    """(edits, start) of the stretch nearest to ``item`` for every end in ``words``."""
    n = len(words)
    row = [(0, k) for k in range(n + 1)]  # (edits, minus nothing) with the stretch's start
    for i, w in enumerate(item, 1):
        prev, row = row, [(i, 0)]
        for j in range(1, n + 1):
            diag, up, left = prev[j - 1], prev[j], row[j - 1]
            best = (diag[0] + (words[j - 1] != w), diag[1])
            if up[0] + 1 < best[0]:
                best = (up[0] + 1, up[1])
            if left[0] + 1 < best[0]:
                best = (left[0] + 1, left[1])
            row.append(best)
    return row


def best_stretch(item: list[int], words: np.ndarray, most: int) -> tuple[int, int, int] | None:
    """(distance, start, stop) of the stretch of ``words`` nearest to ``item``, if within ``most`` edits;
    the leftmost end, then the latest start, among equals."""
    row = _last_row(item, words)
    cost, stop = min((c[0], k) for k, c in enumerate(row))
    return (cost, row[stop][1], stop) if cost <= most else None


def stretches(item: list[int], words: list[int], most: int) -> Iterator[tuple[int, int, int]]:
    """(distance, start, stop) of stretches of ``words`` within ``most`` edits of ``item`` that do not
    overlap: the nearest first, as in ``best_stretch``, then the nearest in what is left."""
    parts = [(0, len(words))]
    while parts:
        lo, hi = parts.pop()
        if hi - lo < len(item) - most:
            continue
        taken = bytearray(hi - lo)
        for (cost, start), stop in sorted(((c, k) for k, c in enumerate(_last_row(item, words[lo:hi])) if c[0] <= most), key=lambda x: (x[0][0], x[1])):
            if not any(taken[start:stop]):
                taken[start:stop] = b"\1" * (stop - start)
                yield cost, lo + start, lo + stop
        if any(taken):
            parts += [(lo + m.start(), lo + m.end()) for m in re.finditer(rb"\0+", taken)]


class Searcher:
    """Seeds and word pairs of one block of items; one per worker process."""

    def __init__(self, items: list[tuple[int, str]]):
        words = [(k, WORD.findall(t.lower())) for k, t in items]
        words = [(k, w) for k, w in words if w]
        self.vocabulary: dict[str, int] = {}
        self.items = [
            (k, np.array([self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in w], np.int64)) for k, w in words
        ]
        self.size = len(self.vocabulary) + 1  # 0 is any word that no item has
        rng = np.random.default_rng(SEED)
        self.symbol = rng.integers(1, 1 << 63, self.size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.length = np.array([len(a) for _, a in self.items], np.int64)
        self.most = np.array([edits_allowed(len(a)) for _, a in self.items], np.int64)
        # pairs, and (item, pair) as one number
        pairs = [a[:-1] * self.size + a[1:] for _, a in self.items]
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.empty(0, np.int64)
        own = [k * len(self.pairs) + np.searchsorted(self.pairs, p) for k, p in enumerate(pairs)]
        self.own = np.unique(np.concatenate(own)) if own else np.empty(0, np.int64)
        # items of a size class share their walks
        classes: dict[int, list[int]] = {}
        short: dict[int, list[tuple[int, int]]] = {}  # words of a piece -> (item, where in it) of its pieces
        for k, (n, d) in enumerate(zip(self.length.tolist(), self.most.tolist(), strict=True)):
            if n >= MIN_WORDS:
                classes.setdefault(n.bit_length() - 1, []).append(k)
            else:  # one of d + 1 pieces is unchanged
                short.setdefault(n // (d + 1), []).extend((k, j * n // (d + 1)) for j in range(d + 1))
        self.short = []
        for q, places in sorted(short.items()):
            place = np.array(places, np.int64)
            sig = self._hash([np.array([self.items[k][1][o + j] for k, o in places]) for j in range(q)])
            order = np.argsort(sig, kind="stable")
            self.short.append((q, sig[order], place[order, 0], place[order, 1]))
        self.classes = []
        for bits, members in sorted(classes.items()):
            n, d = self.length[members], self.most[members]
            steps = STEPS * int(n.min())
            moves = rng.integers(1, 1 << 63, (REPEATS, steps), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            part = [min(steps, (NEAR, 2 * NEAR, max(4 * NEAR, steps // 4), steps)[t % 4]) for t in range(REPEATS)]
            sample = np.array([np.sort(rng.choice(m, SAMPLED, replace=False)) for m in part])
            index = self._index(members, moves, sample)
            self.classes.append((int((n - 1 - 2 * d).min()), int((n + d).max()), moves, sample, index))

    def _hash(self, columns: list[np.ndarray]) -> np.ndarray:
        """One number for each run of words, the j-th words in column j."""
        out = np.zeros(len(columns[0]), np.uint64)
        for ids in columns:
            out = (out ^ self.symbol[ids]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(31)
        return out

    def _signatures(self, ids: np.ndarray, starts: np.ndarray, moves: np.ndarray, sample: np.ndarray) -> np.ndarray:
        """Sampled steps of one CGK walk from every start, as one number each; a walk rests at the end of ``ids``."""
        at, out = starts.copy(), np.zeros(len(starts), np.uint64)
        picked, end = set(sample.tolist()), len(ids) - 1
        for j in range(int(sample[-1]) + 1):
            symbol = self.symbol[ids[at]]
            if j in picked:
                out = (out ^ symbol) * np.uint64(0x9E3779B97F4A7C15)
                out ^= out >> np.uint64(31)
            np.minimum(at + ((symbol * moves[j]) >> np.uint64(63)).astype(np.int64), end, out=at)
        return out

    def _index(self, members: list[int], moves: np.ndarray, sample: np.ndarray):
        """For every repeat the signatures in order, with the item and the start of each walk in it."""
        line, starts, item, offset, at = [], [], [], [], 0
        for k in members:
            n = int(self.length[k])
            places = sorted({j * n // STARTS for j in range(STARTS)})
            starts += [at + o for o in places]
            item += [k] * len(places)
            offset += places
            line += [self.items[k][1], np.zeros(1, np.int64)]  # the end: a word that no item has
            at += n + 1
        ids, starts, item, offset = np.concatenate(line), np.array(starts), np.array(item), np.array(offset)
        index = []
        for t in range(REPEATS):
            sig = self._signatures(ids, starts, moves[t], sample[t])
            order = np.argsort(sig, kind="stable")
            index.append((sig[order], item[order], offset[order]))
        return index

    def find(self, texts: list[str]) -> list[tuple[int, int, int, int, int, int]]:
        """(text, item, distance, words, start, stop): matches, offsets in characters of the text."""
        if not self.items or not texts:
            return []
        get = self.vocabulary.get
        line: list[int] = []
        begin = [0]
        for t in texts:
            line += [get(w, 0) for w in WORD.findall(t.lower())]
            line.append(0)  # no run goes on into the next text
            begin.append(len(line))
        ids, begin = np.array(line, np.int64), np.array(begin)
        pair = np.full(len(ids), -1, np.int64)  # number of the pair that starts here
        both = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
        value = ids[both] * self.size + ids[both + 1]
        at = np.minimum(np.searchsorted(self.pairs, value), max(len(self.pairs) - 1, 0))
        known = self.pairs[at] == value if len(self.pairs) else np.zeros(len(value), bool)
        pair[both[known]] = at[known]
        return self._verify(texts, ids, begin, self._regions(ids, begin, pair))

    def _walked(self, ids: np.ndarray, pair: np.ndarray):
        """(places, their signatures, signatures of items, items, offsets) of every class and repeat, and of short items."""
        held = np.concatenate(([0], np.cumsum(pair >= 0)))
        for need, width, moves, sample, index in self.classes:
            # words inside a stretch that holds as many pairs of the benchmark as any item of the class needs
            reach = np.minimum(np.arange(len(ids)) + width - 1, len(ids))
            dense = np.flatnonzero(held[reach] - held[:-1] >= max(need, 1))
            edge = np.bincount(dense, minlength=len(ids) + 2) - np.bincount(reach[dense] + 1, minlength=len(ids) + 2)
            starts = np.flatnonzero((np.cumsum(edge)[: len(ids)] > 0) & (pair >= 0))
            if len(starts):
                for t, (sigs, items, offsets) in enumerate(index):
                    yield starts, self._signatures(ids, starts, moves[t], sample[t]), sigs, items, offsets
        for q, sigs, items, offsets in self.short:
            n = max(len(ids) - q + 1, 0)
            ok = ids[:n] > 0
            for j in range(q - 1):
                ok &= pair[j : n + j] >= 0
            at = np.flatnonzero(ok)
            yield at, self._hash([ids[at + j] for j in range(q)]), sigs, items, offsets

    def _candidates(self, ids: np.ndarray, pair: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(item, place of a walk, where the item would start) of every collision, in bounded parts."""
        for starts, sig, sigs, items, offsets in self._walked(ids, pair):
            lo, hi = np.searchsorted(sigs, sig), np.searchsorted(sigs, sig, side="right")
            hit = np.flatnonzero(hi > lo)
            at, lo, many = starts[hit], lo[hit], (hi - lo)[hit]
            ends, a = np.cumsum(many), 0
            while a < len(at):
                z = max(int(np.searchsorted(ends, ends[a] - many[a] + CHUNK, side="right")), a + 1)
                count = many[a:z]
                spot = np.repeat(lo[a:z] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
                place = np.repeat(at[a:z], count)
                yield items[spot], place, place - offsets[spot]
                a = z

    def _regions(self, ids: np.ndarray, begin: np.ndarray, pair: np.ndarray) -> list[list[int]]:
        """(text, item, start, stop) of stretches of words, apart for each item, that hold all its matches."""
        kept = []
        for items, place, start in self._candidates(ids, pair):
            text = np.searchsorted(begin, place, side="right") - 1
            text, items, start = np.unique(np.stack([text, items, start]), axis=1)
            n, d = self.length[items], self.most[items]
            lo = np.maximum(start - d, begin[text])
            hi = np.minimum(start + n + 2 * d, begin[text + 1] - 1)
            ok = self._shared(items, lo, hi, pair) >= n - 1 - 2 * d
            kept.append(np.stack([text, items, lo, hi])[:, ok])
        out: list[list[int]] = []
        found = np.concatenate(kept, axis=1) if kept else np.empty((4, 0), np.int64)
        for t, k, a, z in found[:, np.lexsort(found[::-1])].T.tolist():
            if out and out[-1][:2] == [t, k] and a < out[-1][3]:
                out[-1][3] = max(out[-1][3], z)
            else:
                out.append([t, k, a, z])
        return out

    def _shared(self, items: np.ndarray, lo: np.ndarray, hi: np.ndarray, pair: np.ndarray) -> np.ndarray:
        """How many pairs between ``lo`` and ``hi`` are pairs of the item."""
        out = np.zeros(len(items), np.int64)
        size = np.maximum(hi - 1 - lo, 0)
        ends, a = np.cumsum(size), 0
        while a < len(items):
            z = max(int(np.searchsorted(ends, ends[a] - size[a] + CHUNK, side="right")), a + 1)
            n = size[a:z]
            at = np.repeat(lo[a:z] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            row = np.repeat(np.arange(a, z), n)
            row, at = row[pair[at] >= 0], at[pair[at] >= 0]
            key = items[row] * len(self.pairs) + pair[at]
            spot = np.minimum(np.searchsorted(self.own, key), max(len(self.own) - 1, 0))
            out += np.bincount(row[self.own[spot] == key], minlength=len(items))
            a = z
        return out

    def _verify(self, texts: list[str], ids: np.ndarray, begin: np.ndarray, regions: list[list[int]]):
        out = []
        for d, k, lo, hi in regions:
            name, item = self.items[k]
            got = sorted(stretches(item.tolist(), ids[lo:hi].tolist(), edits_allowed(len(item))), key=lambda g: g[1])
            spans = [m.span() for m in WORD.finditer(texts[d])] if got else []
            for cost, start, stop in got:
                a, z = lo + start - int(begin[d]), lo + stop - int(begin[d]) - 1
                out.append((d, name, cost, len(item), spans[a][0] if a < len(spans) else 0, spans[z][1] if z < len(spans) else len(texts[d])))
        return out


_SEARCHERS: dict[str, Searcher] = {}


def _searcher(items: list[tuple[int, str]], key: str) -> Searcher:
    """The searcher of a block; ``key`` is a digest of its items, as workers outlive a benchmark."""
    if key not in _SEARCHERS:
        _SEARCHERS.clear()
        _SEARCHERS[key] = Searcher(items)
    return _SEARCHERS[key]


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The benchmark in blocks of bounded items and words; repeated and NULL items count once or not."""
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))
    block, words = [], 0
    for r in items.where("item_id IS NOT NULL AND text IS NOT NULL").distinct().orderBy("item_id", "text").toLocalIterator():
        n = len(WORD.findall(r.text))
        if block and (len(block) >= BLOCK_ITEMS or words + n > BLOCK_WORDS):
            yield block
            block, words = [], 0
        block.append((r.item_id, r.text))
        words += n
    if block:
        yield block


FOUND = "doc_id long, row_key string, item_id long, distance int, item_words int, start long, stop long"


def benchmark_matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, row_key, item_id, distance, item_words, start, stop): one row per stretch found of a document
    within ``floor(0.2 * words)`` word edits of an item; offsets are characters of the text.

    Empty and NULL texts, items without a word and an empty benchmark match nothing; a repeated row reports
    its matches again; several items may match one stretch. Documents are scanned, never shuffled; the benchmark
    is the query set, taken in blocks of bounded size."""
    spark = docs.sparkSession
    rows = id_text(docs).select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("row_key"), "text")
    result = spark.createDataFrame([], FOUND)
    for n, block in enumerate(_blocks(benchmark)):
        digest = hashlib.sha256(pickle.dumps(block)).hexdigest()
        shared = spark.sparkContext.broadcast(block)  # at most BLOCK_ITEMS items and BLOCK_WORDS words

        def search(batches: Iterator[pa.RecordBatch], shared=shared, key=digest) -> Iterator[pa.RecordBatch]:
            searcher = _searcher(shared.value, key)
            for b in batches:
                got = [m for a in range(0, b.num_rows, 512) for m in _moved(searcher.find(b.column(2).slice(a, 512).to_pylist()), a)]
                at = pa.array([g[0] for g in got], pa.int64())
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
                cols = [pa.array([g[k + 1] for g in got], t) for k, t in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(at), b.column(1).take(at), *cols],
                    ["doc_id", "row_key", "item_id", "distance", "item_words", "start", "stop"],
                )

        found = rows.mapInArrow(search, FOUND)
        result = found if n == 0 else result.unionAll(found)
    return result


def _moved(found, by: int):
    return [(f[0] + by, *f[1:]) for f in found]


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The columns and rows of ``docs`` that hold no benchmark passage."""
    bad = benchmark_matches(docs, benchmark).select(F.col("row_key").alias("k")).distinct()
    keyed = docs.select(F.struct("*").alias("d"), row_key(F.col("doc_id"), F.col("text")).alias("k"))
    return keyed.join(bad, "k", "left_anti").select("d.*")
