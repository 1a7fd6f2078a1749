"""Embedding jobs: text -> fixed-width vector without any network call.

Vectors are kept *sparse and long* — (id, bucket, count) rows — through every shuffle; a dense
``array<double>`` is only built at the end, from at most ``dim`` entries per id. A long text is
split into half-overlapping segments (F5), each segment is embedded (F7), and the segment vectors
are pooled (A5): by default summed and divided by the vector width, as the original pooling does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refrank.session import spread
from refrank.functions.text import DEFAULT_DIM, TOKEN_SPLIT, segments, token_bucket


def text_segments(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, seg_idx, segment) rows; a text of length 0 has no segment."""
    return spread(df.select(key, text)).select(key, F.posexplode(segments(text)).alias("seg_idx", "segment"))


def bucket_counts(df: DataFrame, keys: list[str], text: str, dim: int = DEFAULT_DIM) -> DataFrame:
    """F7 (sparse): (*keys, bucket, cnt) — token counts per hash bucket, partial-aggregated.

    Split, explode, then lower/filter/hash as plain projections (whole-stage codegen; no
    per-element lambda)."""
    return (
        spread(df.select(*keys, text))
        .select(*keys, F.explode(F.split(F.col(text), TOKEN_SPLIT)).alias("tok"))
        .where(F.length("tok") > 0)
        .select(*keys, token_bucket(F.lower(F.col("tok")), dim).alias("bucket"))
        .groupBy(*keys, "bucket")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )


def long_text_counts(df: DataFrame, key: str, text: str = "text", dim: int = DEFAULT_DIM) -> DataFrame:
    """F8 (sparse, un-normalised): per id and bucket, counts over all of its segments, in one shuffle.

    Summing segment vectors and then dividing by a constant is linear, so the pooled vector is
    these sums / ``dim`` (or / number of segments under ``pooling='mean'``)."""
    return bucket_counts(text_segments(df, key, text), [key], "segment", dim)


def pooled_long(df: DataFrame, key: str, text: str = "text", dim: int = DEFAULT_DIM, pooling: str = "width") -> DataFrame:
    """A5 (sparse): (key, bucket, value). ``pooling='width'`` divides the segment sum by ``dim``
    (the original behaviour); ``'mean'`` divides by the number of segments."""
    summed = long_text_counts(df, key, text, dim)
    if pooling == "width":
        return summed.select(key, "bucket", (F.col("cnt") / F.lit(float(dim))).alias("value"))
    if pooling == "mean":
        nseg = text_segments(df, key, text).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
        return summed.join(nseg, key).select(key, "bucket", (F.col("cnt") / F.col("_n")).alias("value"))
    raise ValueError(f"unknown pooling {pooling!r}")


def densify(sparse: DataFrame, key: str, value: str = "value", dim: int = DEFAULT_DIM) -> DataFrame:
    """(key, bucket, value) -> (key, embedding array<double> of width ``dim``).

    The collected map per key holds at most ``dim`` entries, so the group is bounded."""
    return (
        sparse.groupBy(key)
        .agg(F.map_from_entries(F.collect_list(F.struct("bucket", F.col(value).cast("double")))).alias("_m"))
        .select(
            key,
            F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.col("_m")[i], F.lit(0.0))).alias(
                "embedding"
            ),
        )
    )


def embed_texts(df: DataFrame, key: str, text: str = "text", dim: int = DEFAULT_DIM, pooling: str = "width") -> DataFrame:
    """R8 embedding job: (key, embedding) for every row with a non-empty text."""
    return densify(pooled_long(df, key, text, dim, pooling), key, "value", dim)


def sparse_rows(df: DataFrame, key: str, text: str = "text", dim: int = DEFAULT_DIM) -> DataFrame:
    """(key, counts map<bucket, count>, dd): one row per text with a token, ``dd`` its squared norm.

    Texts stay where they are read: what is shuffled is counts, combined before, at most ``dim`` small rows a
    text and partition however long the text. A map holds at most ``dim`` entries."""
    counts = long_text_counts(df, key, text, dim)
    return counts.groupBy(key).agg(
        F.map_from_entries(F.collect_list(F.struct("bucket", "cnt"))).alias("counts"),
        F.sum(F.col("cnt") * F.col("cnt")).alias("dd"),
    )


def sparse_cosine_top_k(rows: DataFrame, query: dict[int, int], key: str, k: int) -> DataFrame:
    """C1 scoring on sparse integer counts: cosine is scale-free, so integer sums give the same
    value as the pooled vectors — and bit-identical results in any engine.

    A scan of the rows and a top-k: the query's buckets (at most ``dim``, few for a keyword) are
    literals, so no row is joined or shuffled."""
    qq = sum(n * n for n in query.values())
    dot = F.lit(0).cast("bigint")
    for bucket, n in sorted(query.items()):
        dot = dot + F.coalesce(F.col("counts")[bucket], F.lit(0)) * n
    similarity = dot / (F.sqrt("dd") * F.sqrt(F.lit(qq))) if qq else F.lit(0.0)
    scored = rows.select(key, similarity.alias("similarity"))
    return scored.orderBy(F.col("similarity").desc(), F.col(key).asc()).limit(k)


def content_hash(content: "str | F.Column" = "content") -> F.Column:
    """Memo key of an embedding input (the text itself decides whether to re-embed)."""
    return F.sha2(F.col(content) if isinstance(content, str) else content, 256)


def pool_segment_vectors(df: DataFrame, key: str, vec: str = "embedding", pooling: str = "width") -> DataFrame:
    """A5 on dense segment vectors (key, vec): element-wise sum divided by the vector width
    (``'width'``, the original behaviour) or by the number of segments (``'mean'``).
    Summarizer is a partial aggregate: a text with very many segments is pre-reduced per task."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    if pooling == "mean":
        agg = Summarizer.mean(array_to_vector(vec))
        return df.groupBy(key).agg(vector_to_array(agg).alias(vec))
    if pooling != "width":
        raise ValueError(f"unknown pooling {pooling!r}")
    summed = df.groupBy(key).agg(vector_to_array(Summarizer.sum(array_to_vector(vec))).alias("_s"))
    return summed.select(key, F.transform("_s", lambda x: x / F.size("_s")).alias(vec))


class HashEmbedder:
    """U6 default embedder (R8): hashed token counts, no model, no network."""

    def __init__(self, dim: int = DEFAULT_DIM, pooling: str = "width"):
        self.dim, self.pooling = dim, pooling

    def embed(self, df: DataFrame, key: str, text: str) -> DataFrame:
        return embed_texts(df, key, text, self.dim, self.pooling)


class BatchEmbedder:
    """U6 pluggable model: ``fn(list[str]) -> array (n, dim)`` applied to Arrow batches of segments.

    The long-text pipeline stays in Spark around the model: F5 segments (rows), the model on each
    segment batch inside ``mapInPandas`` (F7), and A5 pooling as a partial-aggregating vector sum.
    ``fn`` must be picklable; it is shipped to the executors with the task."""

    def __init__(self, fn, dim: int, pooling: str = "width"):
        self.fn, self.dim, self.pooling = fn, dim, pooling

    def embed(self, df: DataFrame, key: str, text: str) -> DataFrame:
        import numpy as np

        fn, dim = self.fn, self.dim
        seg = text_segments(df, key, text)
        key_type = seg.schema[key].dataType.simpleString()

        def run(batches):
            for pdf in batches:
                vecs = np.asarray(fn(pdf["segment"].tolist()), dtype=np.float64).reshape(len(pdf), dim)
                yield pdf[[key, "seg_idx"]].assign(embedding=list(vecs))

        vectors = seg.mapInPandas(run, f"{key} {key_type}, seg_idx int, embedding array<double>")
        return pool_segment_vectors(vectors, key, "embedding", self.pooling)
