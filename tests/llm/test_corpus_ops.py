"""Corpus operators against brute force on small inputs, and on awkward ones."""

import base64
import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import tiktoken
import xxhash
from pyspark.sql import functions as F

from refrank.llm import bpe, decontaminate, lines, pii, quality, rules, simhash, suffixes, toxicity, viterbi
from refrank.llm.components import star_components
from refrank.llm.queries import PIECES, RANKS
from tests.llm.exact_passages import ExactSearcher

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
#: NULL and empty texts and ids, ties, repeated rows and ids, and columns that share names with outputs.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, FP string, row_key string, d string, score string"
AWKWARD = [
    (None, None, None, None, None, "x", "x", "x", "x"),
    (None, "a text without an id but with some words in it", "en", "s", 1, None, None, None, None),
    (1, None, "en", "s", 0, None, None, None, None),
    (2, "", None, "s", 0, None, None, None, None),
    (3, " \n\t ", "en", None, 3, None, None, None, None),
    (4, "One word", "en", "s", 8, None, None, None, None),
    (5, "same words here again and again " * 20, "en", "s", 0, None, None, None, None),
    (5, "same words here again and again " * 20, "en", "s", 0, None, None, None, None),
    (5, "another text under the id of the one before", "en", "s", 0, None, None, None, None),
    (6, "same words here again and again " * 20, "en", "s", 0, None, None, None, None),
    (7, "x" * 300_000 + " é漢😀 " + "y z " * 50_000, "fr", "s", 0, None, None, None, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_vocabulary(public_tokenizers.path(RANKS))


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


# ------------------------------------------------------------------ 1 SimHash


def slow_fingerprint(text):
    words = WORDS.findall(lower(text))
    if not words:
        return 0
    grams = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_groups(rows):
    """component of each row of (doc_id, fp): smallest id reachable at 4 bits or fewer."""
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if (rows[a][1] ^ rows[b][1]).bit_count() <= 4:
                parent[root(a)] = root(b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)].append(i)
    return [min(least[root(k)], default=None) for k in range(len(rows))]


def test_simhash_equals_all_pairs(spark, docs, texts):
    rows = [(i, slow_fingerprint(t)) for i, t in texts.items()]
    want = {(i, f"{fp:016x}", c) for (i, fp), c in zip(rows, slow_groups(rows), strict=True)}
    got = simhash.simhash_groups(docs).select("doc_id", "fingerprint", "component_id").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(rows)


@pytest.mark.parametrize("prefix", [1, 6, 14])
def test_ball_links_keep_every_component(spark, prefix, monkeypatch):
    rng = random.Random(prefix)
    fps = set()
    for _ in range(12):
        fp = rng.getrandbits(64)
        for _ in range(12):  # chains of steps at and just over the bound
            fps.add(fp)
            for b in rng.sample(range(64), rng.choice([1, 2, 3, 4, 4, 5])):
                fp ^= 1 << b
    signed = [(int(np.uint64(x).view(np.int64)),) for x in fps]
    if prefix == 1:
        monkeypatch.setattr(simhash, "CHUNK", 1 << 12)
    links = simhash.near_links(spark.createDataFrame(signed, "fp long"), 4, prefix).collect()
    for a, b in links:
        assert ((a ^ b) & (2**64 - 1)).bit_count() <= 4
    got = defaultdict(set)
    roots = {r.node: r.root for r in star_components(spark.createDataFrame(links, "a long, b long")).collect()}
    for (x,) in signed:
        got[roots.get(x, x)].add(x)
    want = defaultdict(set)
    for (x,), c in zip(signed, slow_groups([(k, s[0] & (2**64 - 1)) for k, s in enumerate(signed)]), strict=True):
        want[c].add(x)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_prefixes_grow_in_number_with_the_fingerprints(spark, docs, monkeypatch):
    for n in (0, 1, 10**6, 10**8, 10**9, 10**10, 10**11):
        p = simhash.prefix_bits_for(n)
        assert 14 <= p <= 31 and n * (1 + p + p * (p - 1) // 2) / 2**p <= simhash.PREFIX_ROWS
    assert simhash.prefix_bits_for(10**6) == 14 < simhash.prefix_bits_for(10**9)
    want = {tuple(r) for r in simhash.simhash_groups(docs).collect()}
    used, links = [], simhash.near_links
    monkeypatch.setattr(simhash, "near_links", lambda d, m, p: used.append(p) or links(d, m, p))
    monkeypatch.setattr(simhash, "PREFIX_ROWS", 1 / 8)
    assert {tuple(r) for r in simhash.simhash_groups(docs).collect()} == want
    assert used[0] > 14


def test_split_work_finds_the_same_links(monkeypatch):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = np.unique(np.concatenate([base ^ np.uint64(1 << int(b)) for b in rng.integers(0, 40, 8)]))
    used = np.zeros(len(fps), np.int64)

    def links():
        parts = simhash.ball_links(fps, fps, used, 50, 2)
        return {tuple(p) for x in parts for p in x.tolist()}

    whole = links()
    monkeypatch.setattr(simhash, "CHUNK", 5000)
    assert links() == whole and whole


def test_simhash_one_row_of_each_group_stays(spark, awkward):
    rows = simhash.simhash_groups(awkward).collect()
    assert len(rows) == len(AWKWARD)
    empty = [r for r in rows if r.fingerprint == "0" * 16]
    assert len(empty) == 4 and {r.component_id for r in empty} == {1}
    kept = simhash.drop_near_duplicates(awkward)
    assert kept.columns == awkward.columns
    assert kept.count() == len({r.component_id for r in rows}) + 1  # the id-less text is a group of its own, id 5 has two
    assert simhash.simhash_groups(awkward.where("false")).count() == 0


def test_components_of_a_long_chain(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(300)], "a long, b long")
    assert {r.root for r in star_components(chain).collect()} == {0}


# ------------------------------------------------------------------ 2 PII


def one(spark, *values):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "doc_id long, text string")
    return [r.text for r in pii.pseudonymise(df, "k").orderBy("doc_id").collect()]


def luhn_ok(digits):
    total = 0
    for k, d in enumerate(reversed([int(c) for c in digits if c.isdigit()])):
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def test_pseudonyms_keep_format_and_links(spark):
    card, spaced, phone, ip, mail, date, ssn, iban, bad = one(
        spark, "4111111111111111", "pay 4111 1111 1111 1111.", "+1 (555) 123-4567", "42.144.35.254", "bob.smith@mail3.example.com",
        "1990-02-28", "123-45-6789", "GB82 WEST 1234 5698 7654 32", "4111111111111112 1990-02-31 999-12-3456 300.1.1.1",
    )
    assert re.fullmatch(r"\d{16}", card) and luhn_ok(card) and card != "4111111111111111"
    assert re.fullmatch(r"pay \d{4} \d{4} \d{4} \d{4}\.", spaced) and re.sub(r"\D", "", spaced) == card
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", phone) and phone != "+1 (555) 123-4567"
    assert all(0 <= int(x) < 256 for x in ip.split(".")) and ip != "42.144.35.254"
    assert re.fullmatch(r"[a-z]{3}\.[a-z]{5}@[a-z]{4}\d\.[a-z]{7}\.com", mail)
    assert re.fullmatch(r"\d{4}-\d{2}-\d{2}", date) and date != "1990-02-28"
    assert re.fullmatch(r"\d{3}-\d{2}-\d{4}", ssn) and ssn != "123-45-6789"
    packed = iban.replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in packed[4:] + packed[:4])) % 97 == 1
    assert bad == "4111111111111112 1990-02-31 999-12-3456 300.1.1.1"


def test_pseudonyms_are_permutations(spark):
    n = 3000
    base = spark.range(n).select(
        F.date_add(F.lit("1950-01-01").cast("date"), F.col("id").cast("int")).cast("string").alias("date"),
        F.concat(F.lit("10.0."), F.floor(F.col("id") / 250).cast("string"), F.lit("."), (F.col("id") % 250).cast("string")).alias("ip"),
        F.concat(F.lit("123-45-"), F.lpad((F.col("id") + 1).cast("string"), 4, "0")).alias("ssn"),
        F.concat(F.lit("+1 (555) 12"), (F.col("id") % 10).cast("string"), F.lit("-"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("phone"),
        F.concat(F.lit("u"), F.col("id").cast("string"), F.lit("@a.example.org")).alias("mail"),
    )
    for kind in base.columns:
        df = base.select(F.monotonically_increasing_id().alias("doc_id"), F.col(kind).alias("text"))
        got = pii.pseudonymise(df, "k").agg(F.countDistinct("text").alias("n"), F.sum("n_found").alias("f")).first()
        assert (got.n, got.f) == (n, n), kind


def test_pii_whole_texts_and_awkward_rows(spark, docs, texts, awkward):
    pattern = re.compile(r"[\w.+-]+@[\w-]+\.[\w.]+|\+1 \(\d{3}\) \d{3}-\d{4}|(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w.])|AKIA[A-Z0-9]{16}|\b[0-9a-f]{40}\b")
    rows = {r.doc_id: r for r in pii.pseudonymise(docs, "k").collect()}
    assert set(rows) == set(texts)
    hit = 0
    for i, text in texts.items():
        private = pattern.findall(text)
        hit += bool(private)
        assert not any(p in rows[i].text for p in private)
        assert len(rows[i].text) == len(text) or "." in text
        if not rows[i].n_found:
            assert rows[i].text == text
    assert hit
    again = pii.pseudonymise_text(awkward, "k")
    assert again.columns == awkward.columns and again.count() == len(AWKWARD)
    assert again.where("text is null").count() == 2
    assert "Python" not in pii.pseudonymise(docs, "k")._jdf.queryExecution().executedPlan().toString()


def test_secrets_in_capitals_and_after_blanks_and_quotes(spark):
    small = "9233a8ec00ff17d2c4b5a6978877665544332211"
    capitals, lower, other, iban_like, prose, *keyed = one(
        spark, f'SET TOKEN = "{small.upper()}" AND GO ON.', f'set token = "{small}" and go on.', f"{small.upper()[::-1]}",
        "KEY AB12" + "0123456789ABCDEF" * 2 + " OK, AB12" + "89ABCDEF" * 4 + " AND, AB12" + "89ABCDEF" * 3 + "0123 THE END",
        "a secret: nothing to tell", "password = hunter", "API_KEY : 'Zebra_tree'", '"token":"abcdefgh"', "passwd: hunter22", "secret=abcdef",
    )
    assert re.fullmatch(r'SET TOKEN = "[0-9A-F]{40}" AND GO ON\.', capitals) and small.upper() not in capitals
    assert lower == capitals.lower() and small not in lower
    assert re.fullmatch("[0-9A-F]{40}", other) and other not in (small.upper()[::-1], capitals[13:53])
    assert re.fullmatch("KEY [0-9A-F]{36} OK, [0-9A-F]{36} AND, [0-9A-F]{32} THE END", iban_like)
    assert not any(x in iban_like for x in ("0123456789ABCDEF", "89ABCDEF89", "EF0123"))
    assert prose == "a secret: nothing to tell"
    for got, private in zip(keyed, ("hunter", "Zebra_tree", "abcdefgh", "hunter22", "abcdef"), strict=True):
        assert private not in got and len(got) >= len(private) + 7


def test_pii_formats_and_links_across_notations(spark):
    rows = [
        (1, "mail John.Doe@Example.com or john.doe@example.com, JOHN.DOE@EXAMPLE.COM too"),
        (2, "born 1990-02-28T10:00:00 and 1990-02-28 as well"),
        (3, "host 2001:db8::1 is 2001:0DB8:0:0:0:0:0:1 and fe80::a1b2:c3d4"),
        (4, "key ghp_abcdefghij0123456789ABCDEFGHIJ012345 here, token = ghp_abcdefghij0123456789ABCDEFGHIJ012345"),
        (5, "call 555 323 4567 or 555-323-4567"),
        (6, "std::vector a::b 12:30:45 :: 1::  ratio 100 200 3000 sk-learn xoxb-none"),
    ]
    got = {r.doc_id: r for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "k1").collect()}
    for i, t in rows[:5]:
        for leak in ("john.doe", "example.", "1990-02-28", "db8", "c3d4", "abcdefghij0123", "323"):
            assert leak not in got[i].text.lower(), (i, got[i].text)
    a, b, c = re.findall(r"\S+@[A-Za-z.]+", got[1].text)
    assert a.lower() == b.lower() == c.lower() and a.lower().endswith(".com") and a[0].isupper() and b == b.lower()
    d = re.findall(r"\d{4}-\d\d-\d\d", got[2].text)
    assert d[0] == d[1] and "T10:00:00" in got[2].text
    six = re.findall(r"(?:[0-9a-f]{4}:){7}[0-9a-f]{4}", got[3].text)
    assert len(six) == 3 and six[0] == six[1] != six[2]
    keys = re.findall(r"ghp_[A-Za-z0-9]{36}", got[4].text)
    assert len(keys) == 2 and keys[0] == keys[1]
    one, two = re.findall(r"\d{3}[ -]\d{3}[ -]\d{4}", got[5].text)
    assert one.replace(" ", "-") == two
    assert got[6].text == rows[5][1] and got[6].n_found == 0
    assert [got[i].kinds for i in range(1, 6)] == [["email"], ["date"], ["ipv6"], ["secret"], ["phone"]]


# ------------------------------------------------------------------ 3 lines


CLAUSES = re.compile(r"[.,;:!?…]+\s+|[。！？、，；：]+\s*")


def slow_spans(all_texts):
    """{doc_id: merged spans}, unit by unit: runs of lines and of clauses, the first occurrence of each stays."""
    seen, out = set(), {}
    for i in sorted(all_texts):
        text, gone = all_texts[i], set()
        here = []
        for kind, ends in (("l", [m.end() for m in re.finditer("\n", text)]), ("c", [m.end() for m in CLAUSES.finditer(text)])):
            cuts = [0, *ends, len(text)]
            parts = [(a, " ".join(text[a:z].lower().split())) for a, z in zip(cuts, cuts[1:], strict=False)]
            parts = [p for p in parts if p[1]]
            for k in range(len(parts)):
                for z in range(k + 1, len(parts) + 1):
                    run = [p for _, p in parts[k:z]]
                    if len(" ".join(run).split(" ")) >= lines.MIN_WORDS or sum(map(len, run)) >= lines.MIN_CHARS:
                        here.append((parts[k][0], parts[z][0] if z < len(parts) else len(text), kind + " ".join(run)))
                        break
        for a, z, unit in sorted(here):
            if unit in seen:
                gone.update(range(a, z))
            seen.add(unit)
        spans, marks = [], sorted(gone)
        for c in marks:
            if spans and spans[-1][1] == c:
                spans[-1][1] = c + 1
            else:
                spans.append([c, c + 1])
        out[i] = [tuple(s) for s in spans]
    return out


@pytest.mark.parametrize("bits", [lines.FILTER_BITS, lines.SEGMENT])
def test_line_dedup_equals_brute_force(docs, texts, bits):
    want = slow_spans(texts)
    got = {r.doc_id: r for r in lines.dedup_lines(docs, bits=bits).collect()}
    assert {i: [tuple(s) for s in r.removed] for i, r in got.items()} == want
    assert any(want.values())
    for i, r in got.items():
        gone = "".join(texts[i][a:z] for a, z in want[i])
        assert len(r.text) == len(texts[i]) - len(gone) and r.n_removed == len(gone)
        assert r.n_spans == len(want[i])


def test_line_dedup_joins_hot_units_alike(docs, texts, monkeypatch):
    """Units joined by a broadcast and units joined by a shuffle give the same cuts."""
    monkeypatch.setattr(lines, "HOT_SEEN", 0)
    monkeypatch.setattr(lines, "HOT", 7)
    got = {r.doc_id: [tuple(s) for s in r.removed] for r in lines.dedup_lines(docs).collect()}
    assert got == slow_spans(texts)


def test_line_dedup_catches_passages_in_mid_line_and_rewrapped(spark):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(3000)]

    def prose(n):
        out = []
        for k in range(n):
            out.append(rng.choice(vocabulary) + (rng.choice(".,") if rng.random() < 0.15 or k == n - 1 else ""))
        return out

    passages = [prose(rng.randint(55, 90)) for _ in range(30)]
    rows, planted = [], {}
    for k, passage in enumerate(passages):
        rows.append((k, " ".join(prose(40) + passage + prose(40))))
        middle = " ".join(prose(33)[:-1] + ["so"] + passage + prose(25))
        words = prose(30) + passage + prose(30)
        wrapped = "\n".join(" ".join(words[a : a + 11]) for a in range(0, len(words), 11))
        rows += [(100 + k, middle), (200 + k, wrapped)]
        planted[100 + k] = planted[200 + k] = len(" ".join(passage))
    rows += [(1000 + k, " ".join(prose(150))) for k in range(50)]
    got = {r.doc_id: r.n_removed for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    shares = [got[i] / n for i, n in planted.items()]
    assert min(shares) > 0.3 and sum(shares) / len(shares) > 0.8
    assert not any(got[1000 + k] for k in range(50)) and not any(got[k] for k in range(30))


def test_line_dedup_short_lines_and_scripts_without_blanks(spark):
    poem = "the fog\ncomes on\nlittle cat feet\nit sits\nlooking over\nharbor"
    chinese = "我们今天去公园散步看到了很多漂亮的花和树木，孩子们在草地上快乐地奔跑玩耍，老人们坐在长椅上聊天下棋，天气晴朗微风吹来让人心情舒畅非常愉快。"
    rows = [(1, poem), (2, "some other words before it all\n" + poem), (3, chinese), (4, "前言部分不同的内容在这里。" + chinese), (5, "the fog")]
    got = {r.doc_id: r.text for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == poem and got[3] == chinese and got[5] == "the fog"
    assert "little cat feet" not in got[2] and "老人们" not in got[4] and got[4].startswith("前言")


def test_line_dedup_awkward(awkward):
    rows = lines.dedup_lines(awkward).collect()
    assert len(rows) == len(AWKWARD)
    # doc 6 repeats a line of another row; doc 7 repeats nothing
    assert sorted(r.n_spans for r in rows) == [0] * 10 + [1]
    assert lines.dedup_lines(awkward.where("false")).count() == 0


# ------------------------------------------------------------------ 4 decontamination


def slow_distance(item, words):
    """Fewest edits between ``item`` and any stretch of ``words``."""
    row = [0] * (len(words) + 1)
    for i, w in enumerate(item, 1):
        prev, row = row, [i]
        for j, x in enumerate(words, 1):
            row.append(min(prev[j - 1] + (x != w), prev[j] + 1, row[j - 1] + 1))
    return min(row)


def edited(words, n, rng, filler):
    words = list(words)
    for _ in range(n):
        k = rng.randrange(len(words))
        what = rng.choice(["cut", "add", "swap"])
        if what == "cut":
            del words[k]
        elif what == "add":
            words.insert(k, rng.choice(filler))
        else:
            words[k] = rng.choice(filler)
    return words


def test_decontamination_recall_and_precision(spark, texts):
    rng = random.Random(5)
    vocab = [f"w{k}" for k in range(4000)]
    items = [(k, " ".join(rng.choices(vocab, k=rng.randint(10, 60)))) for k in range(60)]
    rows, planted = [], {}
    for d in range(400):
        body = rng.choices(vocab, k=rng.randint(20, 400))
        if d % 2 == 0:
            k, text = items[rng.randrange(len(items))]
            words = text.split()
            share = rng.choice([0, 0.05, 0.1, 0.15])
            at = rng.randrange(len(body))
            body[at:at] = edited(words, int(share * len(words)), rng, vocab)
            planted[d] = k
        rows.append((d, " ".join(body)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([*items, (900, None), (901, ""), (902, "two words"), (0, items[0][1]), (None, "x " * 30)], "item_id long, text string")
    got = decontaminate.benchmark_matches(df, bench).collect()
    by = dict(items)
    for r in got:  # every reported match holds exactly
        words = decontaminate.WORD.findall(rows[r.doc_id][1][r.start : r.stop].lower())
        item = decontaminate.WORD.findall(by[r.item_id].lower())
        assert slow_distance(item, words) == r.distance <= decontaminate.edits_allowed(len(item))
    found = {(r.doc_id, r.item_id) for r in got}
    recall = sum((d, k) in found for d, k in planted.items()) / len(planted)
    assert recall >= 0.95
    assert {d for d, _ in found} <= set(planted)


@pytest.mark.parametrize("lead", [0, 3, 30])
@pytest.mark.parametrize("where", ["front", "end", "spread", "mixed"])
def test_decontamination_recall_at_the_tolerance(where, lead):
    """Items with floor(0.2 L) edits, wherever they lie, at document start and later, up to 400 words."""
    rng = random.Random(lead)
    vocab = [f"w{k}" for k in range(300)]
    items = [(k, " ".join(rng.choices(vocab, k=rng.randint(8, 60) if k % 3 else rng.randint(101, 400)))) for k in range(90)]
    rows = []
    for _, text in items:
        words = text.split()
        n = int(0.2 * len(words) + 1e-9)
        gone = {"front": range(n), "end": range(len(words) - n, len(words)), "spread": rng.sample(range(len(words)), n)}
        left = edited(words, n, rng, vocab) if where == "mixed" else [w for k, w in enumerate(words) if k not in gone[where]]
        rows.append(" ".join(rng.choices(vocab, k=lead) + left + rng.choices(vocab, k=30)))
    found = decontaminate.Searcher(items).find(rows)
    assert len({f[1] for f in found if f[0] == f[1]}) >= 0.95 * len(items)
    for d, k, distance, n, a, z in found:
        assert n == len(items[k][1].split()) and distance <= int(0.2 * n + 1e-9)
        assert slow_distance(items[k][1].split(), rows[d][a:z].split()) == distance


def test_decontamination_candidates_come_from_equal_signatures_of_walks():
    rng = random.Random(7)
    vocab = [f"w{k}" for k in range(500)]
    searcher = decontaminate.Searcher([(k, " ".join(rng.choices(vocab, k=40))) for k in range(30)])
    words = rng.choices(vocab, k=50) + searcher_words(searcher, 4) + rng.choices(vocab, k=50)
    ids = np.array([searcher.vocabulary.get(w, 0) for w in words] + [0], np.int64)
    walks = list(searcher._walked(ids, np.zeros(len(ids), np.int64)))
    assert len(walks) == decontaminate.REPEATS  # one size class, no short items
    alike = 0
    for starts, sig, sigs, items, offsets in walks:
        at = starts.tolist().index(50)
        alike += sig[at] in sigs[(items == 4) & (offsets == 0)]
    assert alike >= 0.9 * len(walks)  # the unchanged item walks alike from its start


def searcher_words(searcher, k):
    names = {i: w for w, i in searcher.vocabulary.items()}
    return [names[i] for i in searcher.items[k][1].tolist()]


def test_decontamination_of_whole_tables_equals_exact_search(spark, docs, texts):
    """What the exact search finds in every document, found again, and nothing else."""
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()]
    ids = sorted(texts)
    want = {(ids[f[0]], *f[1:]) for f in ExactSearcher(items).find([texts[i] for i in ids])}
    got = {(r.doc_id, r.item_id, r.distance, r.item_words, r.start, r.stop) for r in decontaminate.benchmark_matches(docs, bench).collect()}
    assert want and got <= want and len(got) >= 0.95 * len(want)
    assert {g[:2] for g in got} == {w[:2] for w in want}


def test_decontamination_short_items_and_scripts_without_blanks(spark):
    items = [(1, "Paris is the capital of France"), (2, "東京は日本の首都であり、世界で最も人口の多い都市圏の一つである。"), (3, "Who wrote Hamlet"), (4, "!!!")]
    rows = [
        (1, "They say that paris is the capital of France."), (2, "They say that Paris was the capital of France."),
        (3, "They say Paris was a capital of France"), (4, "前に何か。東京は日本の首都であり世界で最も人口の多い都市圏の一つである。後に何か。"),
        (5, "大阪は日本の都市です。"), (6, "who wrote, Hamlet?"), (7, "who wrote the Hamlet"),
    ]
    got = decontaminate.benchmark_matches(
        spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    )
    assert {(r.doc_id, r.item_id, r.distance) for r in got.collect()} == {(1, 1, 0), (2, 1, 1), (4, 2, 0), (6, 3, 0)}


def test_decontamination_reports_each_stretch_once():
    item = "one two three four five six seven eight nine ten"
    other = item.replace("four", "4")
    rows = [f"{item} {item} and {other} {item}", f"{other} x y z", "nothing of it", ""]
    found = decontaminate.Searcher([(7, item), (8, "a b c d e f g h")]).find(rows)
    assert [(f[0], f[1], f[2], rows[f[0]][f[4] : f[5]]) for f in found] == [
        (0, 7, 0, item), (0, 7, 0, item), (0, 7, 1, other), (0, 7, 0, item), (1, 7, 1, other)
    ]


def test_decontamination_of_two_benchmarks_in_one_application(spark, monkeypatch):
    """A reused worker does not search for the items of the benchmark before, even if object ids recur."""
    monkeypatch.setattr(decontaminate, "id", lambda x: 1, raising=False)
    texts = [" ".join(f"{c}{k}" for k in range(20)) for c in "ab"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    for k, text in enumerate(texts * 2):
        bench = spark.createDataFrame([(k, text)], "item_id long, text string")
        got = decontaminate.benchmark_matches(df, bench).collect()
        assert [(r.doc_id, r.item_id) for r in got] == [(k % 2, k)]


def test_decontamination_awkward(spark, awkward):
    bench = spark.createDataFrame([(1, "same words here again and again same words here")], "item_id long, text string")
    got = decontaminate.benchmark_matches(awkward, bench).collect()
    assert {r.doc_id for r in got} == {5, 6}
    kept = decontaminate.drop_contaminated(awkward, bench)
    assert kept.columns == awkward.columns and kept.count() == len(AWKWARD) - 3
    assert decontaminate.benchmark_matches(awkward, bench.where("false")).count() == 0


# ------------------------------------------------------------------ 5, 10 classifiers


@pytest.mark.parametrize(("scores", "label", "modulus", "held"), [(quality.quality_scores, "quality", 4, 2), (toxicity.toxicity_scores, "toxic", 5, 0)])
def test_classifiers_on_held_out_rows(spark, scores, label, modulus, held):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    rows = scores(docs, labels).join(labels, "doc_id", "left").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (F_crc(r.doc_id) % modulus == held) and 0 <= r.score <= 1 for r in rows)
    test = [r for r in rows if r.held_out and r[label] is not None]
    right = sum(r.predicted == r[label] for r in test) / len(test)
    assert right >= 0.85
    good, bad = ([r.score for r in test if r[label] == x] for x in (1, 0))
    assert sum(a > b for a in good for b in bad) >= 0.85 * len(good) * len(bad)


def F_crc(doc_id):
    import zlib

    return zlib.crc32(str(doc_id).encode())


@pytest.mark.parametrize(("scores", "label"), [(quality.quality_scores, "quality"), (toxicity.toxicity_scores, "toxic")])
def test_classifiers_without_labels(spark, awkward, labels, scores, label):
    rows = scores(awkward, labels.where("false")).collect()
    assert len(rows) == len(AWKWARD) and {r.score for r in rows} == {0.5}
    ones = spark.createDataFrame([(k, 1, 1) for k in range(8)], "doc_id long, quality int, toxic int")
    assert len({r.score for r in scores(awkward, ones).collect()}) == 1
    assert scores(awkward.where("false"), labels).count() == 0


def test_compiled_rules_equal_their_definition(spark):
    rule = ((0, True, 0.5), (1, False, 2.0))
    frame = spark.createDataFrame([(0.6, 1.0), (0.5, 1.0), (0.6, 3.0)], "log_words double, word_length double")
    got = [r[0] for r in frame.select(quality.compiled({rule: 2.0}, -1.0)).collect()]
    logistic = lambda x: 1 / (1 + np.exp(-x))
    assert np.allclose(got, [logistic(1.0), logistic(-1.0), logistic(-1.0)])


# ------------------------------------------------------------------ 6 suffix arrays


def slow_repeats(rows, size=suffixes.LENGTH):
    first = {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        for k in range(len(t) - size + 1):
            first.setdefault(t[k : k + size], i)
    out = []
    for i, t in rows:
        gone = bytearray(len(t))
        for k in range(len(t) - size + 1):
            if first[t[k : k + size]] < i:
                gone[k : k + size] = b"\1" * size
        kept = bytes(x for x, g in zip(t, gone, strict=True) if not g)
        runs = sum(1 for k in range(len(t)) if gone[k] and not (k and gone[k - 1]))
        out.append((i, len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_suffix_dedup_equals_brute_force(spark, texts, monkeypatch):
    rng = random.Random(3)
    rows = list(texts.items())
    rows += [(10**6 + k, "ab" * rng.randint(0, 200) + rng.choice(rows)[1][:300] + "Of " * rng.randint(0, 150)) for k in range(60)]
    rows += [(5, rows[7][1]), (5, rows[8][1]), (10**8, ""), (10**7, rows[3][1]), (10**7, rows[3][1]), (10**9, "é漢" * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = slow_repeats([(i, t.encode()) for i, t in rows])
    assert sorted(tuple(r)[:5] for r in suffixes.repeated_bytes(df).collect()) == want
    assert any(w[2] for w in want)
    # a filter of a few bits lets records pass that no other document has; results do not change
    small = suffixes.repeated_bytes(df, filter_bits=1 << 12, bucket_bytes=1 << 10)
    assert sorted(tuple(r)[:5] for r in small.collect()) == want


def test_filters_are_put_together_by_segment(spark, monkeypatch):
    """Equal to all positions OR-ed in one place; the driver gets one row a segment, not one a bucket."""
    monkeypatch.setattr(suffixes, "SEGMENT_BITS", 1 << 10)
    rng = np.random.default_rng(2)
    bits, rows, want = 1 << 13, [], np.zeros((2, 1 << 13), np.uint8)
    for _ in range(60):
        at = [np.unique(rng.integers(0, bits, n)).astype(np.uint64) for n in (300, 2)]
        for field, x in zip(want, at, strict=True):
            field[x.astype(np.int64)] = 1
        rows.append(tuple(bytearray(suffixes._pack(np.diff(x, prepend=np.uint64(0)))) for x in at))
    rows.append(tuple(bytearray(suffixes._pack(np.empty(0, np.uint64))) for _ in range(2)))
    df = spark.createDataFrame(rows, "shared binary, hot binary").repartition(5)
    read, collect = [], type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda d: read.append(collect(d)) or read[-1])
    got = suffixes._filters(df, bits)
    assert (np.unpackbits(got, axis=1, bitorder="little") == want).all()
    assert [len(r) for r in read] == [16]


def test_index_family_levels_grow_geometrically():
    rng = np.random.default_rng(0)
    family, seen = suffixes.IndexFamily(), {}
    for n in range(1, 14):
        values = rng.integers(0, 400, 100)
        windows = np.array([f"{v:050d}".encode() for v in values], "S50")
        doc = np.sort(rng.integers(n * 10, n * 10 + 5, 100))
        repeat = family.add(windows, doc)
        for w, d, r in zip(values.tolist(), doc.tolist(), repeat.tolist(), strict=True):
            assert r == (seen.setdefault(w, d) < d)
        ranks = [k for k, _ in family.levels]
        assert ranks == sorted(ranks, reverse=True) and len(set(ranks)) == len(ranks) <= n.bit_length()


@pytest.mark.parametrize("hot", [1, 2, 40])
def test_suffix_dedup_of_hot_keys_equals_brute_force(spark, hot):
    """A gram in very many contexts, a passage that every document has, copies, and rows of one id."""
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdef"), 6))
    gram, passage = "the common gram of all of them", " ".join(word() for _ in range(30))
    rows = []
    for k in range(90):
        own = [" ".join(word() for _ in range(9)) for _ in range(4)]
        rows.append((int(rng.integers(0, 60)), f"{own[0]} {gram} {own[1]} {gram} {own[2]} {passage if k % 3 else ''} {own[3]}"))
    rows += [(100 + k, rows[3][1]) for k in range(20)] + [(None, rows[4][1]), (7, "x" * 200), (8, "x" * 200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = suffixes.repeated_bytes(df, hot_records=hot).collect()
    last = 10**18  # where a NULL id comes
    want = slow_repeats([(last if i is None else i, t.encode()) for i, t in rows])
    assert sorted((last if r.doc_id is None else r.doc_id, *tuple(r)[1:5]) for r in got) == want


def test_hot_keys_spread_over_buckets():
    """Records of one common gram in different contexts share a bucket only until the key is hot."""
    rng = np.random.default_rng(6)
    sides = ["".join(rng.choice(list("abcdefgh"), 40)) for _ in range(600)]
    for n in range(1000):  # a gram whose hash is the smallest of nearly every window that holds it
        texts = [f"{a} a gram #{n:06d}. {b}" for a, b in zip(sides[::2], sides[1::2], strict=True)]
        keys = Counter(k for t in texts for k in set(suffixes.window_keys(np.frombuffer(t.encode(), np.uint8)).tolist()))
        if max(keys.values()) >= 270:
            break
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(300), pa.int64()), pa.array(range(300), pa.int32()), pa.array(texts)], ["rank", "tag", "text"]
    )
    bits = 1 << 16
    every, none = np.full(bits // 8, 255, np.uint8), np.zeros(bits // 8, np.uint8)

    def largest(heavy) -> int:
        found = pa.Table.from_batches(list(suffixes._record_blobs(iter([batch]), 64, every, heavy, bits)))
        return max(len(suffixes._unpack(x.as_py())[1]) for x in found.column("blob"))

    assert largest(none) >= 270  # the gram's records are in one bucket
    windows = sum(len(t) - suffixes.LENGTH + 1 for t in texts)
    assert largest(every) < 1.5 * windows / 64  # an even share


def test_suffix_dedup_awkward(awkward):
    rows = suffixes.repeated_bytes(awkward).collect()
    assert len(rows) == len(AWKWARD)
    six = next(r for r in rows if r.doc_id == 6)
    assert (six.n_removed, six.n_spans) == (six.n_bytes, 1)
    assert all(r.n_removed == 0 for r in rows if r.doc_id != 6)
    assert suffixes.repeated_bytes(awkward.where("false")).count() == 0


def test_long_texts_are_cut_into_overlapping_slices(monkeypatch):
    monkeypatch.setattr(suffixes, "SLICE_BYTES", 100)
    offsets = np.array([0, 20, 1020, 1069, 1119])
    got = Counter()
    for group in suffixes._slices(offsets):
        for d, a, z in group:
            got.update((d, k) for k in range(a, z - suffixes.LENGTH + 1))
    want = {(d, k) for d in range(4) for k in range(int(offsets[d]), int(offsets[d + 1]) - suffixes.LENGTH + 1)}
    assert set(got) == want and set(got.values()) == {1}


# ------------------------------------------------------------------ 7 BPE


def library(ranks):
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})


def test_bpe_equals_the_library(ranks, texts):
    codec, lib = bpe.Codec(bpe.read_ranks(ranks), public_tokenizers.PATTERN), library(ranks)
    rng = random.Random(0)
    letters = "ab 'sS1٣é\n\t\r\x0b\x1c\x85\xa0   　漢字.,!--😀  'll 're<|endoftext|>​\x00"
    fuzz = ["".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(1500)]
    for text in [*texts.values(), *fuzz, "", " ", "x" * 5000]:
        ids = codec.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == lib.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_bpe_query_digests(docs, texts, ranks, awkward):
    lib = library(ranks)
    for r in bpe.encode_digests(docs, ranks, public_tokenizers.PATTERN).collect():
        ids = lib.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    rows = bpe.encode_documents(awkward, ranks, public_tokenizers.PATTERN).collect()
    assert sorted(bytes(r.decoded).decode() for r in rows) == sorted(a[1] or "" for a in AWKWARD)


# ------------------------------------------------------------------ 8 rules


def test_base_statistics_equal_brute_force(docs, texts):
    got = {r.doc_id: r for r in rules.quality_verdicts(docs).collect()}
    for i, text in texts.items():
        words = WORDS.findall(text)
        grams = Counter(zip(words, words[1:], words[2:], strict=False))
        inside = {k + j for k in range(len(words) - 2) if grams[tuple(words[k : k + 3])] > 1 for j in range(3)}
        seen, dups = set(), 0
        for line in text.split("\n"):
            if WORDS.search(line):
                dups += line in seen
                seen.add(line)
        failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
        want = (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dups, len(inside), failed)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want
        assert not (r.kept and r.base_failed)


def test_thresholds_merge_upwards_and_follow_the_group(spark):
    rows = []
    for k in range(600):
        symbols = 300 + k % 40 if k < 300 else k % 40  # one source is full of signs, one is not
        rows.append((k, "en", "signs" if k < 300 else "plain", symbols))
    rows += [(900 + k, "en", "tiny", 5) for k in range(3)] + [(950, None, None, 5)]
    stats = spark.createDataFrame(rows, "doc_id long, lang string, source string, symbol_rate long").select(
        "*", *[F.lit(500).cast("long").alias(r) for r in rules.RATES if r != "symbol_rate"], F.lit(False).alias("base_failed")
    )
    fences = {(r.source, r.rate): r for r in rules.thresholds(rules.sketches(stats)).collect()}
    assert fences["signs", "symbol_rate"].high > 330 > fences["plain", "symbol_rate"].high
    assert fences["plain", "symbol_rate"].basis == "source" and fences["tiny", "symbol_rate"].basis == "lang"
    assert fences[None, "symbol_rate"].basis == "all"
    for name, rows_of in (("signs", range(300)), ("plain", range(300, 600))):
        values = sorted(rows[k][3] for k in rows_of)
        q1, q3 = values[74], values[224]
        assert fences[name, "symbol_rate"].high == q3 + 3 * max(q3 - q1, 20)


def test_rules_awkward(awkward):
    rows = rules.quality_verdicts(awkward).collect()
    assert len(rows) == len(AWKWARD)
    assert all(r.base_failed and not r.kept for r in rows if r.n_words < 50)
    kept = rules.keep_good(awkward)
    assert kept.columns == awkward.columns
    assert rules.quality_verdicts(awkward.where("false")).count() == 0


# ------------------------------------------------------------------ 9 token counts


def unigram_library(model):
    """The same vocabulary as a unigram model of the library, with bytes for what no piece covers."""
    m, scores = sentencepiece.SentencePieceProcessor(model_proto=model), dict(viterbi.read_pieces(model))
    out = b""
    for i in range(m.get_piece_size()):
        kind = 2 if m.is_unknown(i) else 3 if m.is_control(i) else 6 if m.is_byte(i) else 1
        piece = m.id_to_piece(i)
        out += bpe._field(1, bpe._field(1, piece.encode()) + bpe._field(2, scores.get(piece, 0.0)) + bpe._field(3, kind))
    out += bpe._field(2, bpe._field(3, 1) + bpe._field(35, 1) + bpe._field(40, 0) + bpe._field(41, 1) + bpe._field(42, 2))
    out += bpe._field(3, bpe._field(1, b"identity") + bpe._field(3, 1) + bpe._field(4, 0) + bpe._field(5, 1))
    return sentencepiece.SentencePieceProcessor(model_proto=out)


def test_counts_equal_the_library(docs, texts, awkward):
    model = bpe.read_vocabulary(public_tokenizers.path(PIECES))
    lib, counter = unigram_library(model), viterbi.Counter(viterbi.read_pieces(model))
    rng = random.Random(0)
    fuzz = ["".join(rng.choices("ab the 'sS1é\n\t漢字.,!😀  and ing", k=rng.randint(0, 60))) for _ in range(1500)]
    for text in fuzz:
        assert counter.text(text)[0] == len(lib.encode(text))
    for r in viterbi.token_counts(docs, model).collect():
        assert r.n_tokens == len(lib.encode(texts[r.doc_id])) and r.n_chars == len(texts[r.doc_id])
    rows = viterbi.token_counts(awkward, model).collect()
    assert len(rows) == len(AWKWARD) and sum(r.n_tokens == 0 for r in rows) == 3


def test_ties_go_to_the_longest_piece():
    counter = viterbi.Counter([("a", -2.0), ("bc", -6.0), ("abc", -8.0), ("b", -50.0), ("c", -50.0)])
    assert counter.run("abc") == (1, -8.0)
    assert counter.run("abcbc") == (2, -14.0)


def test_suffix_rows_with_colliding_tags_keep_their_bytes(spark):
    """Texts without an id whose 31-bit tags collide: one repeats a passage, the other repeats nothing."""
    rng = random.Random(6)
    passage = "".join(rng.choice("abcdefghij ") for _ in range(80))
    other = "".join(rng.choice("klmnopqrst ") for _ in range(120))
    tag = lambda text: xxhash.xxh64_intdigest(text.encode(), 42) >> 33  # noqa: E731  as Spark hashes a NULL and a text
    first = {tag(f"{passage}{k}"): f"{passage}{k}" for k in range(150_000)}
    hits = [(first[tag(t)], t) for t in (f"{other}{k}" for k in range(150_000)) if tag(t) in first]
    assert hits
    rows = [(1, passage), *[(None, t) for pair in hits[:3] for t in pair], (2, "short")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    tags = df.where("doc_id is null").select(F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 33).alias("t"))
    assert tags.distinct().count() == len(hits[:3])  # they do collide
    got = suffixes.repeated_bytes(df).collect()
    removed = sorted((r.n_bytes, r.n_removed) for r in got)
    want = sorted((len(t), 80 if i is None and t.startswith(passage) else 0) for i, t in rows)
    assert removed == want
