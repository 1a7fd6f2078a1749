"""Sets of known papers as bitmaps, built and united by Spark's bit aggregates.

Papers get dense numbers once. A set is one bitmap per (author, range of 32,768 numbers) that has a member, and of a
bitmap only the 64-bit words that are not zero are held: (word, bits), at most 512 of them. A row is bounded
however many papers an author knows, a hot author is many rows, and a paper known alone costs one word, not 4,096
bytes. Union is a partial aggregate of words; whether a paper is known is one join on (author, range) and a bit.

Cost: an edge list takes about 16 bytes an edge, so does a word; a word holds up to 64 edges. ``bytes_per_edge``
tells what bitmaps written out in full, 4,096 bytes a range, would take for a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refrank.operators.ranking import global_row_number

BYTES = 4096


def number_papers(papers: DataFrame) -> DataFrame:
    """(paper_id, n): numbers 1, 2, ... in id order, NULL left out."""
    ids = papers.select("paper_id").where(F.col("paper_id").isNotNull()).distinct()
    return global_row_number(ids, ["paper_id"], "n").select("paper_id", F.col("n").cast("bigint").alias("n"))


def _bitmaps(words: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """(*by, bucket, bits) of ``words`` (*by, bucket, word, b), which are united where they meet."""
    # dealt by bitmap: one shuffle serves the union of words and the collection of at most WORDS of them
    united = words.repartition(*by, "bucket").groupBy(*by, "bucket", "word").agg(F.bit_or("b").alias("b"))
    return united.groupBy(*by, "bucket").agg(F.collect_list(F.struct("word", "b")).alias("bits"))


def _word(n: Column) -> tuple[Column, Column]:
    """Word of number ``n`` in the bitmap of its range, and the word with its bit alone."""
    at = F.bitmap_bit_position(n)
    return F.floor(at / 64).cast("int"), F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(at, F.lit(64)).cast("int"))


def paper_bitmaps(edges: DataFrame, numbers: DataFrame, by: tuple[str, ...] = ("author_id",)) -> DataFrame:
    """(*by, bucket, bits) of ``edges`` (*by, paper_id); papers without a number have no bit. Repeated edges set one bit."""
    placed = edges.select(*by, "paper_id").join(numbers, "paper_id")
    word, bit = _word(F.col("n"))
    return _bitmaps(placed.select(*by, F.bitmap_bucket_number("n").alias("bucket"), word.alias("word"), bit.alias("b")), by)


def united(bitmaps: DataFrame, by: tuple[str, ...] = ("author_id",)) -> DataFrame:
    """(*by, bucket, bits): the union over everything else, for instance over kinds."""
    return _bitmaps(bitmaps.select(*by, "bucket", F.inline("bits")), by)


def members(bits: Column) -> Column:
    """How many papers a bitmap holds."""
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda n, w: n + F.bit_count(w["b"]))


def sizes(bitmaps: DataFrame, by: tuple[str, ...] = ("author_id",)) -> DataFrame:
    """(*by, n_papers): members of each set."""
    return bitmaps.groupBy(*by).agg(F.sum(members(F.col("bits"))).alias("n_papers"))


def has_bit(bits: Column, n: Column) -> Column:
    """Whether paper number ``n`` is in the bitmap of its range; a missing bitmap has no bit."""
    word, bit = _word(n)
    return F.coalesce(F.exists(bits, lambda w: (w["word"] == word) & (w["b"].bitwiseAND(bit) != 0)), F.lit(False))


def not_known(pairs: DataFrame, bitmaps: DataFrame, numbers: DataFrame) -> DataFrame:
    """``pairs`` (author_id, paper_id, ...) without those that ``bitmaps`` (author_id, bucket, bits) hold."""
    placed = pairs.join(numbers, "paper_id", "left").withColumn("bucket", F.bitmap_bucket_number("n"))
    joined = placed.join(bitmaps.select("author_id", "bucket", "bits"), ["author_id", "bucket"], "left")
    return joined.where(~has_bit(F.col("bits"), F.col("n"))).select(*pairs.columns)


def bytes_per_edge(bitmaps: DataFrame) -> float:
    """Bytes an edge of the bitmaps written out in full."""
    r = bitmaps.agg(F.count(F.lit(1)).alias("rows"), F.sum(members(F.col("bits"))).alias("edges")).first()
    return BYTES * r.rows / r.edges if r.edges else 0.0
