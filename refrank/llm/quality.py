"""Quality classifier: a sparse ensemble of rules.

Statistics of each text feed a small forest; every path from a root to any node is a conjunctive rule;
a lasso logistic regression over the rules keeps a few of them with weights; and the kept rules compile
into one Spark column expression over the statistics, which is the whole scoring model.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refrank.llm.base import materialise, per_text
from refrank.llm.labelled import MAX_LABELLED, held_out, labelled, teachers
from refrank.llm.rules import WORD, repeated_words

MODULUS, REMAINDER, ACCEPT = 4, 2, 0.7
TREES, DEPTH, LASSO = 12, 3, 0.0015
SEED = 7
PUNCTUATION = re.compile(r"[.,;:?!]")
FEATURES = [
    "log_words", "word_length", "distinct_share", "top_share", "repeat_share", "echo_share", "symbol_rate", "bar_rate",
    "shout_rate", "upper_share", "digit_rate", "punct_rate", "dup_line_share", "line_words", "odd_share", "half_gap",
]


def text_features(text: str) -> list[float]:
    """Statistics of one text; all zero but the shares of an empty one."""
    words = WORD.findall(text)
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    chars = sum(map(len, words))
    counts = Counter(words)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    upper = sum(1 for w in words if w.isupper())
    half = n // 2
    halves = [len(set(words[:half])) / max(half, 1), len(set(words[half:])) / (n - half)]
    echo = sum(a == b for a, b in zip(words, words[1:], strict=False))
    symbols = sum(map(text.count, "#*$%&<>"))
    return [
        float(np.log1p(n)),
        chars / n,
        len(counts) / n,
        counts.most_common(1)[0][1] / n,
        repeated_words(words) / n,
        echo / n,
        symbols / n,
        text.count("|") / n,
        text.count("!") / n,
        upper / n,
        sum(map(text.count, "0123456789")) / chars,
        len(PUNCTUATION.findall(text)) / n,
        1 - len(set(lines)) / len(lines),
        float(np.log1p(n / len(lines))),
        sum(1 for w in words if not w[-1].isalnum() and w[-1] not in ".,;:?!") / n,
        abs(halves[0] - halves[1]),
    ]


def document_features(docs: DataFrame) -> DataFrame:
    """(doc_id, statistics...) per input row."""

    def run(texts: list[str]) -> list[pa.Array]:
        m = np.array([text_features(t) for t in texts], np.float64).reshape(len(texts), len(FEATURES))
        return [pa.array(m[:, k].copy()) for k in range(len(FEATURES))]

    return per_text(docs, run, ", ".join(f"{f} double" for f in FEATURES))


Rule = tuple[tuple[int, bool, float], ...]  # (feature, is above, threshold)


def tree_rules(model) -> list[Rule]:
    """Every path of every tree as a rule, each once, simplified to one bound per feature and side."""
    rules: set[Rule] = set()

    def walk(node, path: tuple) -> None:
        if path:
            bounds: dict[tuple[int, bool], float] = {}
            for f, above, t in path:
                tight = max if above else min
                bounds[f, above] = tight(bounds.get((f, above), t), t)
            rules.add(tuple(sorted((f, a, t) for (f, a), t in bounds.items())))
        if node.subtreeDepth():
            split = node.split()
            f, t = split.featureIndex(), round(float(split.threshold()), 6)
            walk(node.leftChild(), (*path, (f, False, t)))
            walk(node.rightChild(), (*path, (f, True, t)))

    for tree in model.trees:
        walk(tree._call_java("rootNode"), ())
    return sorted(rules)


def holds(rule: Rule) -> Column:
    """A rule as a column expression."""
    return reduce(
        lambda a, b: a & b, [(F.col(FEATURES[f]) > t) if above else (F.col(FEATURES[f]) <= t) for f, above, t in rule]
    )


def compiled(weights: dict[Rule, float], intercept: float) -> Column:
    """The fitted ensemble as one column expression with values from 0 to 1."""
    total = reduce(
        lambda a, b: a + b, [F.when(holds(r), F.lit(w)).otherwise(0.0) for r, w in sorted(weights.items())], F.lit(intercept)
    )
    return 1.0 / (1.0 + F.exp(-total))


def fit_rules(rows: DataFrame) -> tuple[dict[Rule, float], float]:
    """Kept rules with weights, and the intercept, from (label, statistics...). With no row, or with rows of
    one label only, there are no rules and the intercept is that of the smoothed share of label 1."""
    found = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("label"), F.lit(0.0)).alias("ones")).first()
    prior = float(np.log((found.ones + 0.5) / (found.n - found.ones + 0.5)))
    if not 0 < found.ones < found.n:
        return {}, prior
    table = rows.select("label", array_to_vector(F.array(*FEATURES)).alias("x"))
    forest = RandomForestClassifier(
        labelCol="label", featuresCol="x", numTrees=TREES, maxDepth=DEPTH, seed=SEED, subsamplingRate=0.7,
        featureSubsetStrategy="0.5", minInstancesPerNode=5,
    )
    rules = tree_rules(forest.fit(table))
    if not rules:
        return {}, prior
    design = rows.select(
        "label", array_to_vector(F.array(*[holds(r).cast("double") for r in rules])).alias("x")
    )
    lasso = LogisticRegression(labelCol="label", featuresCol="x", elasticNetParam=1.0, regParam=LASSO, standardization=False, maxIter=50)
    fitted = lasso.fit(design)
    kept = {r: float(w) for r, w in zip(rules, fitted.coefficients.toArray(), strict=True) if abs(w) > 1e-9}
    return kept, float(fitted.intercept)


def quality_scores(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, held_out, score, predicted) per input row; ``predicted`` is 1 at a score of 0.7 or more.

    Learns from labelled rows whose crc32(doc_id as text) mod 4 is not 2, ``most`` of them at most, chosen
    by hash. Empty and NULL texts have all statistics zero and are scored like others; NULL ids are held
    out. Without labels every score is 0.5."""
    stats = materialise(document_features(docs))
    taught = materialise(labelled(stats, teachers(labels, "quality", MODULUS, REMAINDER, most)).select("label", *FEATURES).coalesce(6))
    weights, intercept = fit_rules(taught)
    return stats.select(
        "doc_id", held_out(F.col("doc_id"), MODULUS, REMAINDER).alias("held_out"), compiled(weights, intercept).alias("score")
    ).select("*", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
