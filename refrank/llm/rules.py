"""Quality rules with thresholds learned from mergeable quantile sketches.

The statistics of a text become integer rates. A group's sketch of a rate is its histogram over a fixed
integer grid: sketches merge by adding counts, the result does not depend on order or partitioning, and a
quantile is off by at most one grid step. Sketches are kept per (lang, source); a group with fewer than
``min_rows`` documents merges upwards into its language and then into the corpus. Each rate is then
fenced at ``q3 + reach * max(q3 - q1, slack)`` of its group, so thresholds follow the group's own texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refrank.llm.base import materialise, row_key

# Fixed values of the rule set.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = re.compile(r"[#*$%&|<>]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
MIN_ROWS = 200
REACH = 3
#: rate -> (largest grid value, least spread). All are per mille but word length, in hundredths.
RATES = {"symbol_rate": (1000, 20), "dup_line_rate": (1000, 100), "repeat_rate": (1000, 60), "word_length": (5000, 60)}
STATS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def repeated_words(words: list[str]) -> int:
    """Words inside 3-word windows that occur twice or more (the first occurrence included)."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    m = len(number)
    pairs = ids[:-1] * m + ids[1:]
    if m >= 2_000_000:  # the three-word key would not fit in 64 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    keys = pairs[:-1] * m + ids[2:]
    _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    again = counts[inverse] > 1
    inside = np.zeros(n, bool)
    for k in range(3):
        inside[k : n - 2 + k] |= again
    return int(inside.sum())


def text_stats(text: str) -> tuple[int, int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words); lines count if they hold a word."""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (
        len(words),
        sum(map(len, words)),
        len(SYMBOLS.findall(text)),
        len(lines),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def document_stats(docs: DataFrame) -> DataFrame:
    """(doc_id, row_key, lang, source, statistics, integer rates, base_failed) per input row.

    A NULL text has no words; a NULL lang or source is a group of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stats = np.array([text_stats(t) for t in b.column(4).to_pylist()], np.int64).reshape(-1, len(STATS))
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:4], *(pa.array(stats[:, k].copy()) for k in range(len(STATS)))],
                ["doc_id", "row_key", "lang", "source", *STATS],
            )

    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        row_key(F.col("doc_id"), F.col("text")).alias("row_key"),
        F.col("lang").cast("string").alias("lang"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    found = rows.mapInArrow(
        run, "doc_id long, row_key string, lang string, source string, " + ", ".join(f"{c} long" for c in STATS)
    )
    per = lambda top, of, scale: F.expr(f"{scale} * {top} div greatest({of}, 1)")
    return found.select(
        "*",
        F.least(per("n_symbols", "n_words", 1000), F.lit(1000)).alias("symbol_rate"),
        per("n_dup_lines", "n_lines", 1000).alias("dup_line_rate"),
        per("n_repeat_words", "n_words", 1000).alias("repeat_rate"),
        F.least(per("word_chars", "n_words", 100), F.lit(5000)).alias("word_length"),
        F.expr(f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words").alias("base_failed"),
    )


def sketches(stats: DataFrame) -> DataFrame:
    """(lang, source, rate, grid, n): the mergeable sketch of every rate of every (lang, source).

    Counts are combined before the shuffle, so a hot source costs at most its grid."""
    rates = F.explode(F.array(*[F.struct(F.lit(r).alias("rate"), F.col(r).alias("grid")) for r in RATES])).alias("r")
    return (
        stats.where(~F.col("base_failed"))
        .select("lang", "source", rates)
        .groupBy("lang", "source", "r.rate", "r.grid")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _quantiles(merged: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rate, total, q1, q3) of sketches merged per key: smallest grid value that reaches the share.

    A window covers one merged sketch: at most the grid's size, whatever the number of documents."""
    from pyspark.sql import Window

    counts = merged.groupBy(*keys, "rate", "grid").agg(F.sum("n").alias("n"))
    part = Window.partitionBy(*keys, "rate")
    run = F.sum("n").over(part.orderBy("grid").rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.select(*keys, "rate", "grid", run.alias("upto"), F.sum("n").over(part).alias("total"))
    at = lambda q: F.min(F.when(F.col("upto") * 4 >= F.col("total") * q, F.col("grid")))
    return ranked.groupBy(*keys, "rate").agg(
        F.max("total").alias("total"), at(1).alias("q1"), at(3).alias("q3")
    )


def thresholds(sketch: DataFrame, min_rows: int = MIN_ROWS, reach: int = REACH) -> DataFrame:
    """(lang, source, rate, low, high, basis): adaptive fences of every group from its own sketch, its
    language's or the corpus's, whichever is the first with ``min_rows`` documents."""
    own = _quantiles(sketch, ["lang", "source"])
    lang = _quantiles(sketch, ["lang"]).select(F.col("lang").alias("l"), F.col("rate").alias("lr"), F.struct("total", "q1", "q3").alias("by_lang"))
    every = _quantiles(sketch, []).select(F.col("rate").alias("er"), F.struct("total", "q1", "q3").alias("by_all"))
    least = F.create_map(*[F.lit(x) for r, (_, s) in RATES.items() for x in (r, s)])
    q = F.when(F.col("total") >= min_rows, F.struct("total", "q1", "q3")).when(
        F.col("by_lang.total") >= min_rows, F.col("by_lang")
    ).otherwise(F.col("by_all"))
    basis = F.when(F.col("total") >= min_rows, "source").when(F.col("by_lang.total") >= min_rows, "lang").otherwise("all")
    reached = (
        own.join(lang, F.col("lang").eqNullSafe(F.col("l")) & (F.col("rate") == F.col("lr")))
        .join(every, F.col("rate") == F.col("er"))
        .select("lang", "source", "rate", q.alias("q"), basis.alias("basis"), least[F.col("rate")].alias("slack"))
    )
    spread = reach * F.greatest(F.col("q.q3") - F.col("q.q1"), F.col("slack"))
    low = F.when(F.col("rate") == "word_length", F.col("q.q1") - spread).otherwise(F.lit(0))
    return reached.select("lang", "source", "rate", low.alias("low"), (F.col("q.q3") + spread).alias("high"), "basis")


def quality_verdicts(docs: DataFrame, min_rows: int = MIN_ROWS, reach: int = REACH) -> DataFrame:
    """(doc_id, row_key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    rates...) per input row. ``kept`` is false for base failures and for a rate outside its group's fences."""
    stats = materialise(document_stats(docs))
    fences = (
        thresholds(sketches(stats), min_rows, reach)
        .groupBy(F.col("lang").alias("tl"), F.col("source").alias("ts"))
        .pivot("rate", list(RATES))
        .agg(F.first(F.struct("low", "high")))
    )
    inside = F.lit(True)
    for r in RATES:
        # a group without a sketch has base failures only
        inside = inside & F.coalesce(F.col(r).between(F.col(f"t.{r}.low"), F.col(f"t.{r}.high")), F.lit(True))
    fences = fences.select("tl", "ts", F.struct(*RATES).alias("t"))
    return stats.join(
        fences, F.col("lang").eqNullSafe(F.col("tl")) & F.col("source").eqNullSafe(F.col("ts")), "left"
    ).select(
        "doc_id", "row_key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & inside).alias("kept"), *RATES,
    )


def keep_good(docs: DataFrame, min_rows: int = MIN_ROWS, reach: int = REACH) -> DataFrame:
    """The columns and rows of ``docs`` that :func:`quality_verdicts` keeps (repeated rows stay repeated)."""
    good = quality_verdicts(docs, min_rows, reach).where("kept").select(F.col("row_key").alias("k")).distinct()
    keyed = docs.select(F.struct("*").alias("d"), row_key(F.col("doc_id"), F.col("text")).alias("k"))
    return keyed.join(good, "k", "left_semi").select("d.*")
