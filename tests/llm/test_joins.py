"""The Jaccard join, hard-negative mining and ranked search against brute force, and on awkward rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from refrank.llm import jaccard, negatives, ranked
from tests.llm.test_corpus_ops import AWKWARD, SCHEMA

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


# ------------------------------------------------------------------ Jaccard join


def components(rows, percent=90):
    """{(doc_id, set size, smallest reachable id)} by comparing every pair."""
    sets = {}
    for i, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", lower(t)) if x]
        sets[i] = {tuple(w)} if 0 < len(w) < 3 else {tuple(w[k : k + 3]) for k in range(len(w) - 2)}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {(i, len(sets[i]), top(i)) for i in sets}


def edited(rnd, words, rate, vocabulary):
    out = list(words)
    for _ in range(rnd.randint(0, max(1, int(len(out) * rate)))):
        k, kind = rnd.randrange(len(out)), rnd.random()
        if kind < 0.4:
            out[k] = rnd.choice(vocabulary)
        elif kind < 0.7:
            out.insert(k, rnd.choice(vocabulary))
        elif len(out) > 1:
            out.pop(k)
    return out


@pytest.fixture(scope="module")
def near_copies():
    rnd = random.Random(5)
    vocabulary = [f"w{i}" for i in range(250)]
    rows = []
    for n in (1, 2, 3, 9, 10, 11, 12, 13, 20, 21, 22, 40, 80, 200, 700):
        base = [rnd.choice(vocabulary) for _ in range(n)]
        for _ in range(rnd.choice([1, 6, 30])):
            rows.append((len(rows), " ".join(edited(rnd, base, 0.04, vocabulary))))
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("hot,block", [(256, 512), (2, 8)])
def test_jaccard_components(spark, near_copies, hot, block):
    docs = spark.createDataFrame(near_copies, "doc_id long, text string").repartition(5)
    got = jaccard.jaccard_groups(docs, hot=hot, block=block)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got.collect()} == components(near_copies)


def test_jaccard_other_thresholds(spark, near_copies):
    docs = spark.createDataFrame(near_copies, "doc_id long, text string")
    got = jaccard.jaccard_groups(docs, percent=70)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got.collect()} == components(near_copies, 70)


def test_allowances_cover_the_distance():
    """Whatever is left out, what a probe sums to exceeds the most that a partner may differ."""
    rnd = np.random.default_rng(3)
    for n in (10, 50, 333, 4000):
        band = jaccard.probed(n, 90)[0]
        _, high, m = jaccard.bands(90)[band]
        most = jaccard.differ(n, n, 90)
        for _ in range(20):
            slots = np.flatnonzero(rnd.random(m) < rnd.random()).astype(np.int32)
            counts = rnd.integers(2, 600, len(slots)).astype(np.int32)
            chosen, wide = jaccard.allocate(n, slots, counts, 90, 256)
            allowance = np.ones(m, int)  # 0 and one more
            allowance[slots[~chosen]] = 0
            for s in wide:
                if s >> jaccard.SEG == 0:
                    allowance[s] += 1
            assert allowance.sum() >= most + 1


def test_one_deletion_neighbours_meet():
    h = jaccard.shingle_hashes(" ".join(f"x{i}" for i in range(300)))
    band = jaccard.probed(len(h), 90)[0]
    less = np.delete(h, 17)
    seg, sums = jaccard.segments(h, band, 90)
    _, smaller = jaccard.segments(less, band, 90)
    j = seg[17]
    minus = jaccard.digests(sums[seg] - h, band, seg, 1)
    assert jaccard.digests(smaller, band, np.arange(len(smaller)), 1)[j] == minus[17]


def test_jaccard_awkward(spark):
    rows = {r: None for r in AWKWARD}
    got = jaccard.jaccard_groups(spark.createDataFrame(AWKWARD, SCHEMA)).collect()
    assert len(got) == len(AWKWARD)
    by = {(r.doc_id, r.n_shingles): r.component_id for r in got}
    assert by[6, 6] == 5 and by[5, 6] == 5 and by[1, 0] == 1 and by[2, 0] == 2 and by[3, 0] == 3 and by[4, 1] == 4
    assert by[None, 0] is None and by[7, [n for i, n in by if i == 7][0]] == 7
    assert rows
    empty = jaccard.jaccard_groups(spark.createDataFrame([], SCHEMA))
    assert empty.columns == ["doc_id", "n_shingles", "component_id", "row_key"] and empty.count() == 0


def test_jaccard_no_pair_of_a_group_is_shipped(spark):
    """600 near copies of one text: what the first pass compares grows with the group, not with its square."""
    rnd = random.Random(2)
    base = [f"b{i}" for i in range(120)]
    rows = [(i, " ".join(w if rnd.random() > 0.004 else f"n{i}" for w in base)) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = jaccard.text_sets(docs, 3, 90)
    classes = sets.groupBy("key").agg(*(F.any_value(c).alias(c) for c in ("n", "sketch", "sigs")))
    classes = classes.withColumn("cid", F.monotonically_increasing_id()).checkpoint()
    shared = jaccard.shared_segments(classes, 90)
    members = jaccard.allocated(shared, classes, 90, 256).where("slot is null").drop("slot")
    n = classes.count()
    assert 200 < n and jaccard.to_first(members, 90).count() < 12 * n


# ------------------------------------------------------------------ hard negatives

VECTOR = "vec_id long, embedding array<float>, label int, rank string, q string"


def mined(rows, every=100):
    part = sorted({(i, l, tuple(math.floor(256 * float(np.float32(x))) for x in v)) for i, v, l in rows
                   if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)})
    dim = max((len(v) for _, _, v in part), default=0)
    part = [(i, l, np.array(v + (0,) * (dim - len(v)), np.int64)) for i, l, v in part]
    out = []
    for a, la, va in part:
        if a % every:
            continue
        ranked_rows = sorted(((-int(va @ v), i, l) for i, l, v in part if i != a))
        for s, p, l in [x for x in ranked_rows if x[2] == la][:5]:
            inside = [x for x in ranked_rows if x[2] != la and 80 * -s <= 100 * -x[0] <= 100 * -s]
            out += [(a, p, k + 1, i, -s, -t) for k, (t, i, _) in enumerate(inside[:5])]
    return Counter(out)


def random_vectors(seed, n=900, dim=12):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(20, dim))
    x = centres[rnd.integers(0, 20, n)] + rnd.normal(scale=0.2, size=(n, dim))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[100:300] = x[100]  # copies
    return [(i, [float(np.float32(c)) for c in v], int(rnd.integers(0, 4)), "r", "q") for i, v in enumerate(x)]


def test_negatives_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(negatives, "LEAF_ROWS", 40)
    monkeypatch.setattr(negatives, "LEAF_SAMPLE", 20)
    monkeypatch.setattr(negatives, "CELL_ROWS", 30)
    monkeypatch.setattr(negatives, "ANCHOR_BLOCK", 5)
    rows = random_vectors(1)
    got = negatives.hard_negatives(spark.createDataFrame(rows, VECTOR).repartition(4), F.col("vec_id") % 20 == 0)
    assert Counter(map(tuple, got.collect())) == mined([r[:3] for r in rows], 20)


def test_negatives_awkward(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (100, [1.0, 0.5], 1), (100, [1.0, 0.5], 1), (200, [1.0, 0.5], 1), (3, [1.0], 1), (4, [0.9, 0.4], 2), (4, [0.9, 0.4], 2),
        (5, None, 1), (6, [1.0, None], 1), (7, [nan, 1.0], 1), (8, [inf, 1.0], 2), (None, [1.0, 1.0], 2), (9, [0.9, 0.4], None),
        (10, [], 2), (11, [0.9, 0.4], 3), (300, [-1.0, -1.0], 1),
    ]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], VECTOR)
    got = negatives.hard_negatives(df, F.col("vec_id") % 100 == 0)
    assert Counter(map(tuple, got.collect())) == mined(rows)
    none = negatives.hard_negatives(spark.createDataFrame([], VECTOR), F.col("vec_id") % 100 == 0)
    assert none.columns == got.columns and none.count() == 0
    with pytest.raises(ValueError):
        negatives.hard_negatives(spark.createDataFrame([(100, [1e9], 1, "", "")], VECTOR), F.col("vec_id") % 100 == 0)


def test_tree_eliminates_and_loses_nothing():
    rnd = np.random.default_rng(4)
    centres = 200 * rnd.normal(size=(30, 8))
    x = np.floor(centres[rnd.integers(0, 30, 4000)] + 10 * rnd.normal(size=(4000, 8)))
    tree = negatives.fit_tree(x[:1000], 20)
    leaf, spans = negatives.leaf_of(tree, x), {}
    for k, points in enumerate(tree.points):
        shape = (len(points) + 1, len(tree.children[k]))
        spans[k] = (np.full(shape, np.inf), np.full(shape, -np.inf))
    for node, rows, squares, child in negatives.descend(tree, x):
        lines = np.vstack([np.sqrt(np.maximum(squares, 0)).T, (x[rows] ** 2).sum(1)[None, :]])
        for j in range(len(tree.children[node])):
            if (child == j).any():
                spans[node][0][:, j], spans[node][1][:, j] = lines[:, child == j].min(1), lines[:, child == j].max(1)
    q = x[:50]
    scores = q @ x.T
    top = np.sort(scores, axis=1)[:, -5:]
    who, left = negatives.surviving_leaves(tree, spans, q, top[:, :1], top[:, -1:])
    visited = set(zip(who.tolist(), left.tolist(), strict=True))
    need = {(a, int(leaf[b])) for a, b in np.argwhere(scores >= top[:, :1])}
    assert need <= visited and len(visited) < 0.5 * 50 * tree.leaves


# ------------------------------------------------------------------ ranked search


def best(docs, items, k=20):
    held = [(i, Counter(TERM.findall(lower(t)))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    total, length = len(held), sum(n for *_, n in held)
    df = Counter(w for _, c, _ in held for w in c)
    out = Counter()
    for item, t in items:
        scores = []
        for i, c, n in held:
            m = 75 + (25 * n * total) // length
            s = sum(
                q * math.floor(1000 * math.log((2 * total + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 12 * m))
                for w, q in Counter(TERM.findall(lower(t))).items() if w in c
            )
            if s > 0:
                scores.append((-s, i is None, i))
        for r, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k]):
            out[item, r + 1, i, -s] += 1
    return out


@pytest.mark.parametrize("shard_rows,block_items,owners", [(8192, 16384, 4), (7, 3, 3), (50, 100, 1)])
def test_ranked_search(spark, shard_rows, block_items, owners):
    rnd = random.Random(8)
    vocabulary = [f"t{int(rnd.paretovariate(0.6))}" for _ in range(400)]
    docs = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(0, 60)))) for i in range(200)]
    docs += [(k, docs[k][1]) for k in (3, 3, 5)]  # repeated rows tie with themselves
    items = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(0, 15)))) for i in range(8)]
    got = ranked.ranked_search(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(3),
        spark.createDataFrame(items, "item_id long, text string"),
        owners=owners, shard_rows=shard_rows, block_items=block_items,
    )
    assert Counter(map(tuple, got.collect())) == best(docs, items)


def test_ranked_awkward(spark):
    items = [(1, "same words, SAME words!"), (1, "same words, SAME words!"), (None, "é漢😀 z"), (2, None), (3, ""), (4, "unheard"), (5, "text")]
    asked = spark.createDataFrame([(*i, "x", 1) for i in items], "item_id long, text string, rank string, score int")
    got = ranked.ranked_search(spark.createDataFrame(AWKWARD, SCHEMA), asked)
    assert Counter(map(tuple, got.collect())) == best([r[:2] for r in AWKWARD], items)
    for docs, some in ((AWKWARD[:1], items), ([], items), (AWKWARD, [])):
        found = ranked.ranked_search(
            spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(some, "item_id long, text string")
        )
        assert found.columns == ["item_id", "rank", "doc_id", "score"] and found.count() == 0


def test_pruned_documents_cannot_come_back():
    """A stage drops a document only if k others stay ahead whatever later owners add."""
    import pyarrow as pa

    bundle = pa.table(
        {
            "shard": pa.array([0], pa.int32()), "part": pa.array([0], pa.int32()), "item": pa.array([0], pa.int32()),
            "terms": pa.array([[0, 1]], pa.list_(pa.int32())), "times": pa.array([[1, 1]], pa.list_(pa.int32())),
            "slots": pa.array([[]], pa.list_(pa.int32())), "scores": pa.array([[]], pa.list_(pa.int64())),
        }
    )
    posts = pa.table(
        {
            "terms": pa.array([[0]], pa.list_(pa.int32())), "starts": pa.array([[0, 4]], pa.list_(pa.int32())),
            "slots": pa.array([[0, 1, 2, 3]], pa.list_(pa.int32())), "parts": pa.array([[90, 80, 50, 49]], pa.list_(pa.int64())),
        }
    )
    out = ranked.add_stage(bundle, posts, np.array([90, 30]), np.array([0, 1]), 0, 2)
    assert out["slots"].to_pylist() == [[0, 1, 2]]  # 50 + 30 can still tie with 80, 49 + 30 cannot
