"""P5 over stored trigram postings: a name search reads the postings of its pattern, not the authors.

Every name is indexed under the different three-character runs of its lower case. The literal stretches of a pattern
(between wildcards, escapes resolved) must occur in a matching name, so their trigrams must too: the authors that
all of their postings share are the candidates, and the real predicate judges those. A pattern without a
literal stretch of three characters has no trigram and scans the names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refrank.operators.profiles import search_by_name

BUCKETS = 64


@dataclass
class NameIndex:
    authors: DataFrame  # (author_id, name), stored by bucket of the id
    postings: DataFrame  # (trigram, author_id), stored by bucket of the trigram
    buckets: int


def trigrams(text: Column) -> Column:
    """The different three-character runs of a text in lower case; none for shorter ones."""
    low = F.lower(text)
    # a sequence may not be empty: short texts start at 1 and are cut by the filter
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(low) - 2)), lambda i: F.substring(low, i, F.lit(3)))
    return F.array_distinct(F.filter(runs, lambda t: F.length(t) == 3))


def _bucket(c: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(buckets)).cast("int")


def build_name_index(authors: DataFrame, path: str, buckets: int = BUCKETS) -> NameIndex:
    """Store names and postings under ``path``; rows without an id or name match nothing and are left out."""
    known = authors.select("author_id", "name").where(F.col("author_id").isNotNull() & F.col("name").isNotNull())
    by_id = known.withColumn("bucket", _bucket("author_id", buckets))
    by_id.repartition("bucket").sortWithinPartitions("author_id").write.partitionBy("bucket").parquet(f"{path}/authors")
    each = known.select(F.explode(trigrams(F.col("name"))).alias("trigram"), "author_id")
    each = each.withColumn("bucket", _bucket("trigram", buckets))
    # sorted files: the trigram's statistics let a reader skip row groups
    each.repartitionByRange("bucket", "trigram", "author_id").sortWithinPartitions("bucket", "trigram", "author_id").write.partitionBy("bucket").parquet(f"{path}/postings")
    return open_name_index(authors, path, buckets)


def open_name_index(like: DataFrame, path: str, buckets: int = BUCKETS) -> NameIndex:
    """A stored index of authors with the column types of ``like``."""
    read = like.sparkSession.read
    kind = like.schema["author_id"].dataType.simpleString()
    return NameIndex(
        read.schema(f"author_id {kind}, name string, bucket int").parquet(f"{path}/authors"),
        read.schema(f"trigram string, author_id {kind}, bucket int").parquet(f"{path}/postings"),
        buckets,
    )


def literal_stretches(text: str, literal: bool) -> list[str]:
    """What every match must hold: the text itself, or its stretches between the wildcards % and _."""
    return [text] if literal else text.replace("_", "%").split("%")  # a backslash stands for itself


def search_names(index: NameIndex, text: str, literal: bool = False) -> DataFrame:
    """The rows of ``profiles.search_by_name`` (author_id, name)."""
    spark = index.authors.sparkSession
    parts = spark.createDataFrame([(p,) for p in literal_stretches(text, literal)], "part string")
    wanted = parts.select(F.explode(trigrams(F.col("part"))).alias("trigram")).distinct()
    wanted = [(r.trigram, r.bucket) for r in wanted.withColumn("bucket", _bucket("trigram", index.buckets)).collect()]  # of one pattern
    if not wanted:
        return search_by_name(index.authors.select("author_id", "name"), text, literal)
    lists = index.postings.where(F.col("bucket").isin(sorted({b for _, b in wanted})) & F.col("trigram").isin([t for t, _ in wanted]))
    shared = lists.groupBy("author_id").agg(F.count_distinct("trigram").alias("n")).where(F.col("n") == len(wanted))
    found = index.authors.join(shared.select("author_id"), "author_id", "left_semi")
    return search_by_name(found.select("author_id", "name"), text, literal)
