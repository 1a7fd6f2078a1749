"""The corpus pipeline against the same stages in plain Python."""

import hashlib

import duckdb
import public_tokenizers

import corpus_pipeline
from refrank.llm import bpe, decontaminate, pii, rules, simhash
from refrank.llm.queries import PSEUDONYM_KEY, QUERIES, RANKS
from tests.llm.exact_passages import least_distance

SF = "/root/testdata/sf0.001"


def test_registered():
    import __spark_entry__

    have = set(__spark_entry__.queries())
    assert set(QUERIES) <= have and "pipeline" in have
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_pipeline_equals_its_stages_by_hand(spark):
    con = duckdb.connect()
    docs = con.execute(f"SELECT doc_id, text FROM read_parquet('{SF}/documents.parquet')").fetchall()
    bench = con.execute(f"SELECT text FROM read_parquet('{SF}/benchmark.parquet')").fetchall()
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id for r in rules.quality_verdicts(frame).where("kept").collect()}
    rows = sorted((i, t) for i, t in docs if i in kept)
    fps = [simhash.text_fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 4 and group[a] != group[b]:
                lo, hi = sorted((group[a], group[b]))
                group = [lo if g == hi else g for g in group]
    rows = [r for k, r in enumerate(rows) if group[k] == k]
    items = [decontaminate.WORD.findall(t.lower()) for (t,) in bench]
    items = [i for i in items if i]

    def leaked(text):
        words = decontaminate.WORD.findall(text.lower())
        return any(
            least_distance(i, words) <= len(i) // 5
            for i in items
            if len(set(i) & set(words)) >= 0.5 * len(set(i))
        )

    rows = [(i, t) for i, t in rows if not leaked(t)]
    named = spark.createDataFrame(rows, "doc_id long, text string")
    texts = {r.doc_id: r.text for r in pii.pseudonymise(named, PSEUDONYM_KEY).collect()}
    codec = bpe.Codec(bpe.read_ranks(bpe.read_vocabulary(public_tokenizers.path(RANKS))), public_tokenizers.PATTERN)
    want = {i: hashlib.sha256(codec.encode(t)).hexdigest() for i, t in texts.items()}
    got = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want and 0 < len(got) < len(docs)


def test_every_stage_takes_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
