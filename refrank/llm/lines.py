"""Substring deduplication by hashing lines and clauses.

A text is cut into pieces twice: at line ends, and at punctuation followed by white space, where a line break is
white space like any other. From every piece on, a unit is the shortest run of pieces of one kind with ``MIN_WORDS``
words or ``MIN_CHARS`` characters, so that short lines and clauses count with their neighbours. Units are normalised (lower
case, white space runs to one blank), digested and grouped over the whole corpus; the earliest occurrence of
each, by (doc_id, row, character offset), stays. The union of all later ones is cut, with the offsets in the
original text kept. A passage that recurs in mid-line or with other line breaks shares its clauses; what is not
found of it is the part of a clause at either end.

Most units occur once, so a first pass only counts 64-bit hashes of units, and the second ships the 128-bit digests
and places of those whose hash falls on a repeated one, by a filter of fixed size.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refrank.llm.base import LONG_MAX, id_text, materialise, row_key

MIN_WORDS = 8
MIN_CHARS = 64
FILTER_BITS = 1 << 26
SEGMENT = 1 << 16
HOT = 256  # digests that are joined by a broadcast, at most
HOT_SEEN = 64  # times in a sample of one in 64

# White space as str.split has it, marks that end a clause before white space, marks that always do.
BLANK = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
MARKS, WIDE_MARKS = ".,;:!?…", "。！？、，；："
LINE_END = re.compile(r"\n")
WIDE = re.compile(f"[{WIDE_MARKS}]")
TOKEN = re.compile(f"[^{BLANK}{WIDE_MARKS}]*[{WIDE_MARKS}]+|[^{BLANK}{WIDE_MARKS}]+")
CLAUSE_END = re.compile(f"[{MARKS}]+[{BLANK}]+|[{WIDE_MARKS}]+[{BLANK}]*")


def pieces(text: str, end: re.Pattern[str]) -> list[int]:
    """Where every piece with a word starts."""
    cuts = [0, *(m.end() for m in end.finditer(text)), len(text)]
    return [a for a, z in zip(cuts[:-1], cuts[1:], strict=True) if a < z and not text[a:z].isspace()]


def line_words(text: str) -> tuple[list[str], list[int]]:
    """(words in lower case, how many there are up to the end of every line with a word)."""
    words: list[str] = []
    ends = []
    for line in text.lower().split("\n"):
        here = line.split()
        if here:
            words += here
            ends.append(len(words))
    return words, ends


def clause_words(text: str, words: list[str]) -> tuple[list[str], list[int]]:
    """The same up to the end of every clause; ``words`` are those of the text, which wide marks cut further."""
    marks = MARKS
    if WIDE.search(text):
        words, marks = [m.group() for m in TOKEN.finditer(text.lower())], MARKS + WIDE_MARKS
    ends = [k for k, w in enumerate(words, 1) if w[-1] in marks]
    if words and (not ends or ends[-1] < len(words)):
        ends.append(len(words))
    return words, ends


def word_ends(words: list[str]) -> np.ndarray:
    """Characters of the words before each word, and of all."""
    return np.concatenate(([0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))))


def runs(words: list[str], size: np.ndarray, ends: list[int], min_words: int, min_chars: int) -> tuple[list[int], list[int], list[str]]:
    """(first piece, piece after the last, normalised text) of the shortest run from every piece on that is long enough.

    Characters are those of the words and the blanks inside a piece."""
    upto = np.array([0, *ends])
    chars = size[upto] + upto - np.arange(len(upto))
    last = np.minimum(np.searchsorted(upto, upto[:-1] + min_words), np.searchsorted(chars, chars[:-1] + min_chars))
    n = int(np.searchsorted(last, len(upto)))  # a run that does not fit is followed by none that does
    first, stop = range(n), last[:n].tolist()
    return list(first), stop, [" ".join(words[a:z]) for a, z in zip(upto[:n].tolist(), upto[last[:n]].tolist(), strict=True)]


def text_units(text: str, min_words: int = MIN_WORDS, min_chars: int = MIN_CHARS) -> list[tuple[re.Pattern[str], list[int], list[int], list[bytes]]]:
    """For lines and for clauses: (end of a piece, first pieces, pieces after the last, units in UTF-8 after a byte for their kind)."""
    words, ends = line_words(text)
    if not words:
        return []
    size = word_ends(words)
    parts, cuts = clause_words(text, words)
    own = size if parts is words else word_ends(parts)
    out = []
    for kind, end, one in (
        ("l", LINE_END, runs(words, size, ends, min_words, min_chars)),
        ("c", CLAUSE_END, runs(parts, own, cuts, min_words, min_chars)),
    ):
        first, stop, found = one
        out.append((end, first, stop, [(kind + u).encode("utf-8", "surrogatepass") for u in found]))
    return out


def repeated_hashes(docs: DataFrame, min_words: int, min_chars: int, bits: int) -> np.ndarray:
    """Packed filter of ``bits`` positions: those of the 64-bit hashes that more than one unit has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes = [xxhash.xxh3_64_intdigest(u) for t in b.column(0).to_pylist() for *_, found in text_units(t, min_words, min_chars) for u in found]
            different, times = np.unique(np.array(hashes, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(different.view(np.int64)), pa.array(times.astype(np.int32))], ["h", "n"])

    def pack(group: pa.Table) -> pa.Table:
        octets = np.zeros(SEGMENT, np.uint8)
        octets[group["p"].to_numpy() % SEGMENT] = 1
        return pa.table({"s": group["s"].slice(0, 1), "octets": pa.array([np.packbits(octets, bitorder="little").tobytes()])})

    again = id_text(docs).select("text").mapInArrow(run, "h long, n int").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1")
    spots = again.select(F.pmod("h", F.lit(bits)).alias("p")).distinct().withColumn("s", F.expr(f"p div {SEGMENT}"))
    out = np.zeros(bits // 8, np.uint8)
    packed = spots.groupBy("s").applyInArrow(pack, "s long, octets binary")
    for r in packed.coalesce(8).toLocalIterator():  # bits / 8 bytes in all
        out[r.s * SEGMENT // 8 : (r.s + 1) * SEGMENT // 8] = np.frombuffer(bytes(r.octets), np.uint8)
    return out


def units(docs: DataFrame, passing: np.ndarray, min_words: int = MIN_WORDS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(rank, row, digest, start, stop) of the units that may recur; ``rank`` is the doc_id, NULL after every id."""
    shared = docs.sparkSession.sparkContext.broadcast(passing)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        octets = shared.value
        bits = 8 * len(octets)
        for b in batches:
            row, start, stop, digest = [], [], [], []
            for k, t in enumerate(b.column(2).to_pylist()):
                for end, first, last, found in text_units(t, min_words, min_chars):
                    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found)).view(np.int64) % bits
                    left = np.flatnonzero((octets[h >> 3] >> (h & 7).astype(np.uint8)) & 1).tolist()
                    if left:  # offsets only where they are wanted
                        at = [*pieces(t, end), len(t)]
                        row += [k] * len(left)
                        start += [at[first[i]] for i in left]
                        stop += [at[last[i]] for i in left]
                        digest += [hashlib.blake2b(found[i], digest_size=16).digest() for i in left]
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(at), b.column(1).take(at), pa.array(digest, pa.binary()), pa.array(start, pa.int32()), pa.array(stop, pa.int32())],
                ["rank", "row", "digest", "start", "stop"],
            )

    key = F.unhex(row_key(F.col("doc_id"), F.col("text")))
    rows = id_text(docs).select(F.coalesce("doc_id", F.lit(LONG_MAX)).alias("rank"), key.alias("row"), "text")
    return rows.mapInArrow(run, "rank long, row binary, digest binary, start int, stop int")


def repeated_spans(
    docs: DataFrame, min_words: int = MIN_WORDS, min_chars: int = MIN_CHARS, bits: int = FILTER_BITS
) -> DataFrame:
    """(row, spans array<struct<start, stop>>): the units of each distinct row that are cut.

    Occurrences of a digest are counted and their minimum taken with map-side combining; only digests that
    occur again go back to their units."""
    found = materialise(units(docs, repeated_hashes(docs, min_words, min_chars, bits), min_words, min_chars))
    place = F.struct("rank", "row", "start")

    def cut(rows: DataFrame, small: bool) -> DataFrame:
        again = (
            rows.groupBy("digest")
            .agg(F.min(place).alias("first"), F.max(place).alias("last"))
            .where(F.col("first") != F.col("last"))
            .select("digest", "first")
        )
        joined = rows.join(F.broadcast(again) if small else again, "digest")
        return joined.where(place != F.col("first")).select("row", "start", "stop")

    hot = hot_digests(found)
    spans = cut(found.where(~F.col("digest").isin(hot)), False).union(cut(found.where(F.col("digest").isin(hot)), True)) if hot else cut(found, False)
    return spans.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("spans"))


def hot_digests(found: DataFrame) -> list[bytearray]:
    """The most frequent digests of a sample of the units, ``HOT`` at most: they are joined by a broadcast of as many rows
    instead of meeting in one task. Which ones are found changes the plan, not the result."""
    some = found.where(F.pmod(F.xxhash64("row", "start"), F.lit(64)) == 0)
    counts = some.groupBy("digest").count().where(F.col("count") > HOT_SEEN)
    return [r.digest for r in counts.orderBy(F.desc("count")).limit(HOT).collect()]


def dedup_lines(
    docs: DataFrame, min_words: int = MIN_WORDS, min_chars: int = MIN_CHARS, bits: int = FILTER_BITS
) -> DataFrame:
    """(doc_id, n_chars, n_removed, n_spans, removed array<struct<start, stop>>, text) per input row.

    Offsets are characters of the original text, half open; spans that touch are one; ``text`` is what stays.
    Identical rows (same id and text) count as one occurrence and get the same result. Texts without a unit,
    empty and NULL ones among them, come back whole. ``bits`` sets the work of the second pass, not results."""
    rows = id_text(docs).withColumn("row", F.unhex(row_key(F.col("doc_id"), F.col("text"))))
    span = pa.struct([("start", pa.int32()), ("stop", pa.int32())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, chars, gone, cuts = [], [], [], []
            for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                merged: list[dict[str, int]] = []
                for s in spans or []:
                    if merged and s["start"] <= merged[-1]["stop"]:
                        merged[-1]["stop"] = max(merged[-1]["stop"], s["stop"])
                    else:
                        merged.append(dict(s))
                at, parts = 0, []
                for s in merged:
                    parts.append(text[at : s["start"]])
                    at = s["stop"]
                parts.append(text[at:])
                out.append("".join(parts))
                chars.append(len(text))
                gone.append(sum(s["stop"] - s["start"] for s in merged))
                cuts.append(merged)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(chars, pa.int64()), pa.array(gone, pa.int64()), pa.array(cuts, pa.list_(span)), pa.array(out, pa.string())],
                ["doc_id", "n_chars", "n_removed", "removed", "text"],
            )

    joined = rows.join(repeated_spans(docs, min_words, min_chars, bits), "row", "left").select("doc_id", "text", "spans")
    done = joined.mapInArrow(
        cut, "doc_id long, n_chars long, n_removed long, removed array<struct<start:int,stop:int>>, text string"
    )
    return done.select(
        "doc_id", "n_chars", "n_removed", F.size("removed").cast("bigint").alias("n_spans"), "removed", "text"
    )
