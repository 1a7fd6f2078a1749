"""Registered queries of the corpus operators: each applies its operator, with production parameters, to
its whole table. ``ORACLE`` (from ``oracle``) holds DuckDB SQL where SQL expresses the result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refrank.llm import bpe, decontaminate, jaccard, lines, negatives, pii, quality, ranked, rules, simhash, suffixes, toxicity, viterbi
from refrank.llm.base import read
from refrank.llm.oracle import ORACLE as ORACLE

RANKS = "byte_bpe_multi_50k.tiktoken"
PIECES = "piece_bpe_32k.model"
PSEUDONYM_KEY = "corpus-pseudonyms-1"

Query = Callable[[SparkSession, str], DataFrame]


def op1_simhash(spark: SparkSession, d: str) -> DataFrame:
    return simhash.simhash_groups(read(spark, d, "documents")).select("doc_id", "fingerprint", "component_id")


def op2_pii(spark: SparkSession, d: str) -> DataFrame:
    return pii.pseudonymise(read(spark, d, "documents"), PSEUDONYM_KEY)


def op3_lines(spark: SparkSession, d: str) -> DataFrame:
    # spans as JSON text, which compares alike across engines
    return lines.dedup_lines(read(spark, d, "documents")).withColumn("removed", F.to_json("removed"))


def op4_decontaminate(spark: SparkSession, d: str) -> DataFrame:
    return decontaminate.benchmark_matches(read(spark, d, "documents"), read(spark, d, "benchmark")).drop("row_key")


def op5_quality(spark: SparkSession, d: str) -> DataFrame:
    return quality.quality_scores(read(spark, d, "documents"), read(spark, d, "labels"))


def op6_suffixes(spark: SparkSession, d: str) -> DataFrame:
    return suffixes.repeated_bytes(read(spark, d, "documents")).drop("removed")


def op7_bpe(spark: SparkSession, d: str) -> DataFrame:
    ranks = bpe.read_vocabulary(public_tokenizers.path(RANKS))
    return bpe.encode_digests(read(spark, d, "documents"), ranks, public_tokenizers.PATTERN)


def op8_rules(spark: SparkSession, d: str) -> DataFrame:
    return rules.quality_verdicts(read(spark, d, "documents")).drop("row_key")


def op9_token_counts(spark: SparkSession, d: str) -> DataFrame:
    model = bpe.read_vocabulary(public_tokenizers.path(PIECES))
    return viterbi.token_counts(read(spark, d, "documents"), model)


def op10_toxicity(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.toxicity_scores(read(spark, d, "documents"), read(spark, d, "labels"))


def op11_jaccard(spark: SparkSession, d: str) -> DataFrame:
    return jaccard.jaccard_groups(read(spark, d, "documents")).drop("row_key")


def op12_negatives(spark: SparkSession, d: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(read(spark, d, "embeddings").withColumn("label", label), F.col("vec_id") % 100 == 0)


def op13_ranked(spark: SparkSession, d: str) -> DataFrame:
    return ranked.ranked_search(read(spark, d, "documents"), read(spark, d, "benchmark"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_simhash, op2_pii, op3_lines, op4_decontaminate, op5_quality, op6_suffixes, op7_bpe, op8_rules,
        op9_token_counts, op10_toxicity, op11_jaccard, op12_negatives, op13_ranked,
    )
}
