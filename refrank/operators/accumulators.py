"""Profile vectors as invertible sums: a like, a clear or any other change of edges costs what it changes.

Two tables, stored in hash buckets of the author:

* ``edges`` (author_id, paper_id, kinds): the known papers, their kinds as bits of one integer;
* ``sums`` (author_id, n, sums): over the distinct papers of the profile kinds that have an embedding, their
  number and the sum of their vectors in fixed point (multiples of 2^-32).

Fixed-point sums are exact in any order and can be taken back, so after any sequence of changes they are bit by bit
what a recomputation from all edges gives. A batch of changes reads and rewrites the buckets of its authors and
the embeddings of the papers that enter or leave a profile; it never reads the other buckets.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from refrank.schemas import KIND_LIKED, KIND_NOT_LIKED, KIND_REFERENCE, KIND_WRITE, PROFILE_KINDS
from refrank.session import cut_lineage
from refrank.sources.parts import new_part, read_directory, read_parts, write_directory, write_parts

BUCKETS = 256
CHUNK = 64  # components summed in one row
SCALE_BITS = 32
LIMIT = 128.0  # components are smaller; then 2^24 papers an author cannot overflow, nor 2^31 of unit vectors
BITS = {KIND_WRITE: 1, KIND_REFERENCE: 2, KIND_LIKED: 4, KIND_NOT_LIKED: 8}
PROFILE_BITS = sum(BITS[k] for k in PROFILE_KINDS)
LINES = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("part", T.StringType())])


@dataclass
class ProfileStore:
    spark: SparkSession
    path: str
    buckets: int
    edges: T.StructType
    sums: T.StructType
    version: int
    parts: dict[int, str]  # bucket -> current part, the same name in both tables


def _schemas(author: T.DataType, paper: T.DataType) -> tuple[T.StructType, T.StructType]:
    a, p = T.StructField("author_id", author), T.StructField("paper_id", paper)
    bits = T.StructField("kinds", T.IntegerType())
    sums = [T.StructField("n", T.LongType()), T.StructField("sums", T.ArrayType(T.LongType()))]
    return T.StructType([a, p, bits]), T.StructType([a, *sums])


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("author_id"), F.lit(buckets)).cast("int")


def _bit(kind: Column) -> Column:
    out = F.lit(0)
    for name, bit in BITS.items():
        out = F.when(kind == name, F.lit(bit)).otherwise(out)
    return out


def fixed_sums(signed: DataFrame, embeddings: DataFrame) -> DataFrame:
    """(author_id, n, sums) of ``signed`` (author_id, paper_id, sign): the vectors of its papers, added or taken away.

    Sums of integers by (author, ``CHUNK`` components), combined before the shuffle: a hot author is reduced in every
    task, and a vector is one row a chunk. Papers without an embedding count for nothing."""

    def fixed(x: Column) -> Column:
        wrong = F.raise_error(F.lit(f"a component is not below {LIMIT}")).cast("double")
        return F.round(F.when(F.abs(x) < F.lit(LIMIT), x).otherwise(wrong) * F.lit(float(1 << SCALE_BITS))).cast("bigint")

    vectors = embeddings.where(F.col("embedding").isNotNull()).select("paper_id", F.transform("embedding", fixed).alias("q"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("q"), F.lit(1)), F.lit(CHUNK))
    chunks = F.transform(starts, lambda at: F.slice("q", at, CHUNK))
    each = signed.join(vectors.where(F.size("q") > 0), "paper_id").select("author_id", "sign", F.posexplode(chunks).alias("i", "x"))
    held = [F.sum(F.col("sign") * F.get("x", F.lit(j))).alias(f"s{j}") for j in range(CHUNK)]
    totals = each.groupBy("author_id", "i").agg(F.sum("sign").alias("n"), F.max(F.size("x")).alias("width"), *held)
    chunk = F.slice(F.array(*[f"s{j}" for j in range(CHUNK)]), F.lit(1), F.col("width")).alias("s")
    line = F.array_sort(F.collect_list(F.struct("i", chunk)))  # one entry a chunk
    return totals.groupBy("author_id").agg(F.max("n").alias("n"), F.flatten(F.transform(line, lambda c: c["s"])).alias("sums"))


def _commit(store: ProfileStore, edges: DataFrame, sums: DataFrame, touched: list[int]) -> ProfileStore:
    """Write the touched buckets anew, then the directory; all others stay as they are."""
    version = store.version + 1
    fresh = {b: new_part(b) for b in touched}
    names = store.spark.createDataFrame(list(fresh.items()), "bucket int, part string")
    for rows, name in ((edges, "edges"), (sums, "sums")):
        placed = rows.withColumn("bucket", _bucket(store.buckets)).join(F.broadcast(names), "bucket").drop("bucket")
        write_parts(placed.repartition("part", F.pmod(F.xxhash64(rows.columns[1]), F.lit(8))), f"{store.path}/{name}")
    parts = {**store.parts, **fresh}
    write_directory(store.spark, store.path, list(parts.items()), LINES, version)
    return ProfileStore(store.spark, store.path, store.buckets, store.edges, store.sums, version, parts)


def build_profiles(interactions: DataFrame, embeddings: DataFrame, path: str, buckets: int = BUCKETS) -> ProfileStore:
    """Store all edges and their sums under ``path``. NULL paper ids and unknown kinds are left out."""
    spark = interactions.sparkSession
    schemas = _schemas(interactions.schema["author_id"].dataType, interactions.schema["paper_id"].dataType)
    store = ProfileStore(spark, path, buckets, *schemas, 0, {})
    known = interactions.where(F.col("paper_id").isNotNull() & F.col("author_id").isNotNull())
    edges = (
        known.select("author_id", "paper_id", _bit(F.col("kind")).alias("bit"))
        .groupBy("author_id", "paper_id")
        .agg(F.bit_or("bit").alias("kinds"))
        .where("kinds <> 0")
    )
    edges = cut_lineage(edges)
    mine = edges.where(F.col("kinds").bitwiseAND(F.lit(PROFILE_BITS)) != 0)
    sums = fixed_sums(mine.select("author_id", "paper_id", F.lit(1).cast("bigint").alias("sign")), embeddings)
    return _commit(store, edges, sums, list(range(buckets)))


def open_profiles(
    spark: SparkSession, path: str, author: T.DataType, paper: T.DataType, buckets: int = BUCKETS, version: int | None = None
) -> ProfileStore:
    version, lines = read_directory(spark, path, LINES, version)
    return ProfileStore(spark, path, buckets, *_schemas(author, paper), version, {r.bucket: r.part for r in lines})


def stored_edges(store: ProfileStore, buckets: list[int] | None = None) -> DataFrame:
    parts = [store.parts[b] for b in (store.parts if buckets is None else buckets) if b in store.parts]
    return read_parts(store.spark, f"{store.path}/edges", store.edges, parts).drop("part")


def stored_sums(store: ProfileStore, buckets: list[int] | None = None) -> DataFrame:
    parts = [store.parts[b] for b in (store.parts if buckets is None else buckets) if b in store.parts]
    return read_parts(store.spark, f"{store.path}/sums", store.sums, parts).drop("part")


def apply_changes(store: ProfileStore, changes: DataFrame, embeddings: DataFrame) -> ProfileStore:
    """The next version after ``changes`` (author_id, paper_id, kind, present): edges that are there or gone.

    Repeated changes and such that change nothing cost nothing; an edge both added and taken away in one batch
    is there. An author whose last profile paper goes has no vector any more."""
    bit = _bit(F.col("kind"))
    of = (
        changes.where(F.col("paper_id").isNotNull() & F.col("author_id").isNotNull())
        .select("author_id", "paper_id", F.when(F.col("present"), bit).otherwise(0).alias("add"), F.when(~F.col("present"), bit).otherwise(0).alias("cut"))
        .groupBy("author_id", "paper_id")
        .agg(F.bit_or("add").alias("add"), F.bit_or("cut").alias("cut"))
    )
    of = cut_lineage(of)
    touched = sorted(r.b for r in of.select(_bucket(store.buckets).alias("b")).distinct().collect())  # at most the buckets
    if not touched:
        return store
    old, add, cut = (F.coalesce(F.col(c), F.lit(0)) for c in ("kinds", "add", "cut"))
    # the edges of untouched authors in these buckets pass through; a hot author is spread by paper
    merged = cut_lineage(
        stored_edges(store, touched)
        .join(of, ["author_id", "paper_id"], "full")
        .select("author_id", "paper_id", old.alias("old"), old.bitwiseAND(F.bitwise_not(cut)).bitwiseOR(add).alias("kinds"))
    )
    has = lambda c: F.when(F.col(c).bitwiseAND(F.lit(PROFILE_BITS)) != 0, F.lit(1).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    moved = merged.select("author_id", "paper_id", (has("kinds") - has("old")).alias("sign")).where("sign <> 0")
    delta = fixed_sums(moved, embeddings).select("author_id", F.col("n").alias("dn"), F.col("sums").alias("ds"))
    total = F.when(F.col("sums").isNull(), F.col("ds")).when(F.col("ds").isNull(), F.col("sums"))
    sums = (
        stored_sums(store, touched)
        .join(delta, "author_id", "full")
        .select(
            "author_id",
            (F.coalesce("n", F.lit(0)) + F.coalesce("dn", F.lit(0))).alias("n"),
            total.otherwise(F.zip_with("sums", "ds", lambda a, b: a + b)).alias("sums"),
        )
        .where("n <> 0")
    )
    return _commit(store, merged.where("kinds <> 0").select("author_id", "paper_id", "kinds"), sums, touched)


def like(store: ProfileStore, likes: DataFrame, embeddings: DataFrame) -> ProfileStore:
    """D5 for any number of (author_id, paper_id)."""
    return apply_changes(store, likes.select("author_id", "paper_id", F.lit(KIND_LIKED).alias("kind"), F.lit(True).alias("present")), embeddings)


def clear(store: ProfileStore, authors: DataFrame, embeddings: DataFrame, kind: str = KIND_LIKED) -> ProfileStore:
    """D6 for any number of authors (author_id): every edge of ``kind`` goes; unknown authors change nothing."""
    ids = authors.select("author_id").distinct()
    buckets = sorted(r.b for r in ids.select(_bucket(store.buckets).alias("b")).distinct().collect())
    held = stored_edges(store, buckets).where(F.col("kinds").bitwiseAND(F.lit(BITS[kind])) != 0)
    gone = held.join(ids, "author_id", "left_semi")
    return apply_changes(store, gone.select("author_id", "paper_id", F.lit(kind).alias("kind"), F.lit(False).alias("present")), embeddings)


def delete(store: ProfileStore, authors: DataFrame, embeddings: DataFrame) -> ProfileStore:
    """Every edge of the authors (author_id) goes, and with them their sums."""
    ids = authors.select("author_id").distinct()
    buckets = sorted(r.b for r in ids.select(_bucket(store.buckets).alias("b")).distinct().collect())
    held = edges_long(store, buckets).join(ids, "author_id", "left_semi")
    return apply_changes(store, held.withColumn("present", F.lit(False)), embeddings)


def edges_long(store: ProfileStore, buckets: list[int] | None = None) -> DataFrame:
    """(author_id, kind, paper_id): the stored edges as the other operators take them."""
    kinds = F.array(*[F.when(F.col("kinds").bitwiseAND(F.lit(bit)) != 0, F.lit(name)) for name, bit in BITS.items()])
    return stored_edges(store, buckets).select("author_id", F.explode(F.array_compact(kinds)).alias("kind"), "paper_id")


def profile_vectors(store: ProfileStore) -> DataFrame:
    """A4 from the sums: (author_id, embedding, n_embedded)."""
    scale = F.col("n") * F.lit(float(1 << SCALE_BITS))
    mean = F.transform("sums", lambda s: s / scale)
    return stored_sums(store).select("author_id", mean.alias("embedding"), F.col("n").alias("n_embedded"))
