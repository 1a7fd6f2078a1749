"""Token counts of a unigram vocabulary without building tokens.

An Aho-Corasick automaton lists every vocabulary match that ends at each character; a forward pass keeps,
per position, only the best score and the number of pieces on the best path. Ties go as in the tokenizer:
a later candidate must be strictly better, and candidates come by start, leftmost (longest piece) first.
A character that no piece covers costs the unknown penalty and counts one piece per UTF-8 byte.

Pieces hold the space mark only at their front, so no path crosses the start of a space run that follows
a word: runs are segmented alone, exactly, and their counts are memoised. Scores add up in 64-bit floats
from the run's start, where the whole numbers of rank-scored vocabularies are exact.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from refrank.llm.base import id_text

MARK = "▁"
RUN = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
UNKNOWN_PENALTY = 10.0  # fixed value: below the lowest piece score
PLACEHOLDER = -1e8  # fixed value: scores at or below it stand for no score
MEMO_CHARS = 48
MEMO_SIZE = 400_000


class Counter:
    """Best-path counts of one vocabulary; one per worker process."""

    def __init__(self, pieces: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if MARK in piece.lstrip(MARK):
                raise ValueError("a piece holds the space mark after another character")
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.memo: dict[str, tuple[int, float]] = {}

    def run(self, run: str) -> tuple[int, float]:
        """(pieces, score) of the best path over one run."""
        n = len(run)
        score, count = [0.0] * (n + 1), [0] * (n + 1)
        found: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for end, match in self.automaton.iter(run):
            found[end + 1].append(match)
        for end in range(1, n + 1):
            best, pieces, single = None, 0, False
            for length, s in sorted(found[end], key=lambda m: -m[0]):
                single |= length == 1
                total = score[end - length] + s
                if best is None or total > best:
                    best, pieces = total, count[end - length] + 1
            if not single:
                total = score[end - 1] + self.unknown
                if best is None or total > best:
                    best, pieces = total, count[end - 1] + len(run[end - 1].encode("utf-8", "surrogatepass"))
            score[end], count[end] = best, pieces
        return count[n], score[n]

    def text(self, text: str) -> tuple[int, float]:
        """(pieces, score) of a whole text, with the space mark in front and for every space."""
        if not text:
            return 0, 0.0
        memo, pieces, score = self.memo, 0, 0.0
        for run in RUN.findall(MARK + text.replace(" ", MARK)):
            got = memo.get(run)
            if got is None:
                got = self.run(run)
                if len(run) <= MEMO_CHARS:
                    if len(memo) >= MEMO_SIZE:
                        memo.clear()
                    memo[run] = got
            pieces += got[0]
            score += got[1]
        return pieces, score


def read_pieces(model: bytes) -> list[tuple[str, float]]:
    """Normal pieces of a serialised vocabulary with their scores.

    Pieces at the placeholder score (runs of the space mark in rank-scored vocabularies) go one below the
    lowest real score: next to -1e9 the tokenizer's 32-bit sums lose every other score."""
    m = sentencepiece.SentencePieceProcessor(model_proto=model)
    pieces = [
        (m.id_to_piece(i), float(m.get_score(i)))
        for i in range(m.get_piece_size())
        if not (m.is_unknown(i) or m.is_control(i) or m.is_byte(i) or m.is_unused(i))
    ]
    floor = min(s for _, s in pieces if s > PLACEHOLDER) - 1.0
    return [(p, max(s, floor)) for p, s in pieces]


_COUNTERS: dict[int, Counter] = {}


def _counter(model: bytes) -> Counter:
    key = hash(model)
    if key not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[key] = Counter(read_pieces(model))
    return _COUNTERS[key]


def token_counts(docs: DataFrame, model: bytes) -> DataFrame:
    """(doc_id, n_chars, n_bytes, n_tokens, score) per input row; an empty or NULL text has no tokens."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a vocabulary file: of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(shared.value)
        for b in batches:
            texts = b.column(1).to_pylist()
            got = [counter.text(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array(np.fromiter(map(len, texts), np.int64, len(texts))),
                    pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()),
                    pa.array([g[0] for g in got], pa.int64()),
                    pa.array([g[1] for g in got], pa.float64()),
                ],
                ["doc_id", "n_chars", "n_bytes", "n_tokens", "score"],
            )

    return id_text(docs).mapInArrow(run, "doc_id long, n_chars long, n_bytes long, n_tokens long, score double")
