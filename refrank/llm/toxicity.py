"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

The lexicon is a short list of common insults and what the rows that may teach add to it: words, and stems
of long words, that are surely more frequent in toxic documents. Features are densities of the lexicon, its closeness to second-person words,
capitals, punctuation, and rates of obfuscated spellings (digits or signs inside words, letters set apart),
which are undone before the lexicon is asked.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refrank.llm.base import id_text, materialise, per_text
from refrank.llm.labelled import MAX_LABELLED, held_out, labelled, teachers

MODULUS, REMAINDER, ACCEPT = 5, 0, 0.5
CALIBRATION = 1  # crc32 mod 5 of the rows that calibrate and do not grow trees
LEXICON_SIZE = 4000
MIN_SUPPORT = 5  # toxic documents that hold an entry
MIN_ODDS = 1.0  # least lower bound, two standard errors down, of an entry's log odds ratio
INSULT = 3.0  # weight of a listed insult that is not learned
NEAR = 5  # words
BLEND = 0.02  # share of the trees' own chance in a score: orders the texts of one calibration step
ROUNDS, DEPTH, STEP, SEED = 20, 4, 0.25, 11

# Second-person words of the four languages, and signs that stand for letters.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer tú ti usted ustedes vosotros tus".split()
)
INSULTS = frozenset(
    "idiot moron loser stupid dumb pathetic worthless scum trash disgusting clown fool jerk bastard imbecile dimwit pig filth vermin "
    "idiote imbécile crétin abruti salaud ordure connard nul dummkopf trottel arschloch idiotin blödmann versager abschaum "
    "estúpido imbécil tonto basura cabrón inútil asqueroso".split()
)
LOOKALIKE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": "", "_": "", "-": "", ".": ""})
TOKEN = re.compile(r"[^\s]+")
EDGES = "\"'`.,;:?!()[]{}<>|#*%&-_~/\\"
INSIDE = re.compile(r"[^\W\d_][\d@$!*_.\-]+[^\W\d_]")
APART = re.compile(r"\b(?:[^\W\d_][ .\-*_]){3,}[^\W\d_]\b")
STEMS = (4, 5)
FEATURES = [
    "hit_rate", "stem_rate", "weight_rate", "log_hits", "log_stems", "top_weight", "distinct_hits", "near_second",
    "second_rate", "upper_share", "shout_rate", "punct_rate", "inside_rate", "undone_hits", "apart_hits", "hit_lines",
    "log_words",
]


def tokens(text: str) -> list[str]:
    return [w for w in (t.strip(EDGES) for t in TOKEN.findall(text.lower())) if w]


def entries(words: list[str]) -> set[str]:
    """What a lexicon may hold of a text: its words and, marked by a star, stems of longer ones."""
    out = set(words)
    for w in set(words):
        out.update(w[:n] + "*" for n in STEMS if len(w) > n)
    return out


def learn_lexicon(rows: DataFrame, size: int = LEXICON_SIZE) -> dict[str, float]:
    """entry -> weight of the ``size`` strongest entries of (label, text). Document frequencies are
    pre-aggregated per batch and summed by Spark; what comes back is bounded by ``size``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = [Counter(), Counter()]
            for label, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                both[int(label)].update(entries(tokens(text)))
            keys = list(both[0] | both[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), *(pa.array([c[k] for k in keys], pa.int64()) for c in both)], ["entry", "clean", "toxic"]
            )

    n = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    clean, toxic = n.get(0.0, 0), n.get(1.0, 0)
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (clean + 1.0))
    odds = odds - 2 * F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    found = (
        rows.select("label", "text")
        .mapInArrow(count, "entry string, clean long, toxic long")
        .groupBy("entry")
        .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        .where(F.col("toxic") >= MIN_SUPPORT)
        .select("entry", odds.alias("weight"))
        .where(F.col("weight") >= MIN_ODDS)
        .orderBy(F.desc("weight"), "entry")
        .limit(size)
        .collect()
    )
    return dict.fromkeys(INSULTS, INSULT) | {r.entry: r.weight for r in found}


def text_features(text: str, lexicon: dict[str, float]) -> list[float]:
    """Dense features of one text; an empty text has zeros only."""
    raw = TOKEN.findall(text)
    n = len(raw)
    if not n:
        return [0.0] * len(FEATURES)
    words = [t.strip(EDGES) for t in text.lower().split()]
    hits, stems, weight, top = [], 0, 0.0, 0.0
    second = []
    get = lexicon.get
    for k, w in enumerate(words):
        got = get(w)
        if got is not None:
            hits.append(k)
        elif len(w) > STEMS[0]:
            got = max((get(w[:m] + "*", 0.0) for m in STEMS if len(w) > m), default=0.0)
            if got:
                stems += 1
                hits.append(k)
        if got:
            weight += got
            top = max(top, got)
        if w in SECOND_PERSON:
            second.append(k)
    near = 0
    if second and hits:
        at = np.searchsorted(second, hits)
        line = np.array([-(10**9), *second, 10**9])
        near = int((np.minimum(np.array(hits) - line[at], line[at + 1] - np.array(hits)) <= NEAR).sum())
    odd = [w for w in INSIDE.findall(text)]
    undone = sum(1 for w in words if not w.isalpha() and (get(w.translate(LOOKALIKE)) or 0) > 0) if odd or not text.isascii() or any(c in text for c in "013457@$") else 0
    apart = sum(1 for m in APART.findall(text) if get(re.sub(r"[ .\-*_]", "", m.lower()))) if re.search(r"\b\w[ .\-*_]\w[ .\-*_]\w\b", text) else 0
    whole = len(hits) - stems
    return [
        whole / n,
        stems / n,
        weight / n,
        float(np.log1p(whole)),
        float(np.log1p(stems)),
        top,
        float(len({words[k] for k in hits})),
        near / n,
        len(second) / n,
        sum(1 for w in raw if w.isupper()) / n,
        text.count("!") / n,
        sum(map(text.count, ".,;:?")) / n,
        len(odd) / n,
        float(np.log1p(undone)),
        float(np.log1p(apart)),
        whole / (1 + text.count("\n")),
        float(np.log1p(n)),
    ]


def toxicity_features(docs: DataFrame, lexicon: dict[str, float]) -> DataFrame:
    """(doc_id, features...) per input row."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)  # at most LEXICON_SIZE entries

    def run(texts: list[str]) -> list[pa.Array]:
        m = np.array([text_features(t, shared.value) for t in texts], np.float64).reshape(len(texts), len(FEATURES))
        return [pa.array(m[:, k].copy()) for k in range(len(FEATURES))]

    return per_text(docs, run, ", ".join(f"{f} double" for f in FEATURES))


def toxicity_scores(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, held_out, score, predicted) per input row; ``predicted`` is 1 at a score of 0.5 or more.

    Learns from labelled rows whose crc32(doc_id as text) mod 5 is not 0, ``most`` of them at most, chosen
    by hash; remainder 1 calibrates only. Empty and NULL texts have all features zero and are scored like
    others; NULL ids are held out. If the rows that grow trees or those that calibrate lack a label, every
    score is the smoothed share of toxic rows."""
    taught = teachers(labels, "toxic", MODULUS, REMAINDER, most)
    trains = F.crc32(F.col("doc_id").cast("string")) % MODULUS != CALIBRATION
    lexicon = learn_lexicon(labelled(id_text(docs), taught.where(trains)))
    rows = materialise(
        toxicity_features(docs, lexicon).select("doc_id", array_to_vector(F.array(*FEATURES)).alias("features"))
    )
    out = held_out(F.col("doc_id"), MODULUS, REMAINDER).alias("held_out")
    known = materialise(labelled(rows, taught).select("label", "features", trains.alias("trains")).coalesce(6))
    n = {(r.trains, r.label): r["count"] for r in known.groupBy("trains", "label").count().collect()}
    if len(n) < 4:
        ones = sum(v for (_, label), v in n.items() if label)
        prior = (ones + 0.5) / (sum(n.values()) + 1.0)
        return rows.select("doc_id", out, F.lit(prior).alias("score"), F.lit(int(prior >= ACCEPT)).alias("predicted"))
    trees = GBTClassifier(labelCol="label", maxIter=ROUNDS, maxDepth=DEPTH, stepSize=STEP, seed=SEED, subsamplingRate=0.8).fit(
        known.where("trains")
    )
    chance = vector_to_array("probability")[1].alias("chance")
    isotonic = IsotonicRegression(labelCol="label", featuresCol="chance", predictionCol="score").fit(
        trees.transform(known.where("NOT trains")).select("label", chance)
    )
    scored = isotonic.transform(trees.transform(rows).select("doc_id", chance))
    score = (1 - BLEND) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), "score")) + BLEND * F.col("chance")
    return scored.select("doc_id", out, score.alias("score")).select(
        "*", (F.col("score") >= ACCEPT).cast("int").alias("predicted")
    )
