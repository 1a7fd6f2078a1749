"""Exact search for benchmark passages, for tests: every stretch within the tolerance is found.

An item with d edits allowed is cut into d + 1 pieces; an edit touches one piece at most, so a match holds one
unchanged. Runs that equal a piece are candidates; the q-gram lemma and the exact distance judge them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from refrank.llm.decontaminate import CHUNK, MIN_WORDS, SEED, WORD, edits_allowed, stretches


def least_distance(item: list[str], words: list[str]) -> int:
    """Fewest edits between ``item`` and any stretch of ``words``, one row of the table at a time."""
    place = np.arange(len(words) + 1)
    own = np.array(words, object)
    row = np.zeros(len(words) + 1, np.int64)
    for w in item:
        step = np.concatenate(([row[0] + 1], np.minimum(row[1:] + 1, row[:-1] + (own != w))))
        row = np.minimum.accumulate(step - place) + place
    return int(row.min())


class ExactSearcher:
    """Seeds and word pairs of a list of items."""

    def __init__(self, items: list[tuple[int, str]]):
        words = [(k, WORD.findall(t.lower())) for k, t in items]
        words = [(k, w) for k, w in words if len(w) >= MIN_WORDS]
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
        # size of the seed -> hashes in order, with the item and the seed's place in it
        seeds: dict[int, list[tuple[int, int]]] = {}
        for k, (n, d) in enumerate(zip(self.length.tolist(), self.most.tolist(), strict=True)):
            seeds.setdefault(n // (d + 1), []).extend((k, j * n // (d + 1)) for j in range(d + 1))
        self.seeds = []
        for q, places in sorted(seeds.items()):
            runs = np.array([self.items[k][1][o : o + q] for k, o in places])
            place = np.array(places, np.int64)
            sig = self._hash([runs[:, j] for j in range(q)])
            order = np.argsort(sig, kind="stable")
            self.seeds.append((q, sig[order], place[order, 0], place[order, 1]))

    def _hash(self, columns: list[np.ndarray]) -> np.ndarray:
        """One number for each run of words, the j-th words in column j."""
        out = np.zeros(len(columns[0]), np.uint64)
        for ids in columns:
            out = (out ^ self.symbol[ids]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(31)
        return out

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

    def _candidates(self, ids: np.ndarray, pair: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(item, place of a seed, where the item would start) of every seed found, in bounded parts."""
        for q, sigs, items, offsets in self.seeds:
            n = max(len(ids) - q + 1, 0)
            ok = ids[:n] > 0
            for j in range(q - 1):  # a seed's pairs are pairs of the block
                ok &= pair[j : n + j] >= 0
            at = np.flatnonzero(ok)
            sig = self._hash([ids[at + j] for j in range(q)])
            lo, hi = np.searchsorted(sigs, sig), np.searchsorted(sigs, sig, side="right")
            at, lo, many = at[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
            ends, a = np.cumsum(many), 0
            while a < len(at):
                z = max(int(np.searchsorted(ends, ends[a] - many[a] + CHUNK, side="right")), a + 1)
                count = many[a:z]
                seed = np.repeat(lo[a:z] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
                place = np.repeat(at[a:z], count)
                yield items[seed], place, place - offsets[seed]
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
