"""The like stream with keyed state: nothing twice, nothing late lost, the store read once."""

import json

import pytest
from pyspark.sql import functions as F

from refrank.sources.store import scratch_path
from refrank.streaming.likes import EVENTS_SCHEMA
from refrank.streaming.stateful import run_stateful_likes

EDGES = "author_id long, kind string, paper_id long"


def land(spark, path, likes, first):
    from datetime import datetime, timedelta

    rows = [
        (first + n, datetime(2024, 1, 1) + timedelta(days=day), a, "purchase" if p != -1 else "view", 0.0, json.dumps({"k": p} if p is not None else {}))
        for n, (a, p, day) in enumerate(likes)
    ]
    spark.createDataFrame(rows, EVENTS_SCHEMA).coalesce(1).write.mode("append").parquet(path)


@pytest.fixture(scope="module")
def run(spark):
    source, sink, checkpoint = (scratch_path(spark, n) for n in ("events", "likes", "state"))
    stored_path = scratch_path(spark, "stored")
    stored = [(1, "liked", 10), (1, "write", 11), (2, "liked", None), (3, "liked", 30)]
    spark.createDataFrame(stored, EDGES).write.parquet(stored_path)
    store = spark.read.schema(EDGES).parquet(stored_path)
    seen = []

    def step(likes):
        if likes:
            land(spark, source, likes, 1000 * len(seen))
        run_stateful_likes(spark, source, store, sink, checkpoint, max_files=1)
        seen.append(sorted(tuple(r) for r in spark.read.schema(EDGES).parquet(sink).collect()))
        return seen[-1]

    return step


def test_likes_come_once_whatever_their_order(run):
    # known before, twice in a batch, a paper the author wrote, no paper, another event
    first = run([(1, 10, 9), (1, 12, 9), (1, 12, 8), (1, 11, 9), (2, 20, 9), (2, None, 9), (3, -1, 9)])
    assert first == [(1, "liked", 11), (1, "liked", 12), (2, "liked", 20)]
    # a run without new files, then likes older than all before: new ones are kept, old ones add nothing
    assert run([]) == first
    late = run([(1, 12, 1), (3, 30, 1), (3, 31, 0), (2, 21, -400)])
    assert late == sorted([*first, (3, "liked", 31), (2, "liked", 21)])


def test_no_batch_reads_the_store_again(spark, run):
    """With the stored edges gone the stream goes on: they were read into its state once."""
    before = run([])
    empty = spark.createDataFrame([], EDGES)
    source, sink, checkpoint = (scratch_path(spark, n) for n in ("events", "likes", "state"))
    land(spark, source, [(5, 1, 0)], 0)
    run_stateful_likes(spark, source, spark.createDataFrame([(5, "liked", 1)], EDGES), sink, checkpoint)
    land(spark, source, [(5, 1, 0), (5, 2, 0)], 10)
    run_stateful_likes(spark, source, empty, sink, checkpoint)
    assert [tuple(r) for r in spark.read.schema(EDGES).parquet(sink).collect()] == [(5, "liked", 2)]
    assert run([]) == before


def test_state_is_kept_without_python_and_stored_edges_come_first(spark):
    """No Python worker in the stream's plan, and one batch of stored edges before the first like."""
    from refrank.streaming.likes import like_stream
    from refrank.streaming.stateful import new_likes

    source, sink, checkpoint, known = (scratch_path(spark, n) for n in ("events", "likes", "state", "known"))
    likes = [(a, p, 0) for a in range(20) for p in range(30)] + [(7, p, 1) for p in range(2000)]
    land(spark, source, likes, 0)
    edges = [(a, "liked", p) for a in range(20) for p in range(0, 30, 2)] + [(7, "liked", p) for p in range(0, 2000, 2)]
    stored = spark.createDataFrame([*edges, (8, "not liked", 1), (None, "liked", 1)], EDGES)
    run_stateful_likes(spark, source, stored, sink, checkpoint)
    got = [tuple(r) for r in spark.read.schema(EDGES).parquet(sink).collect()]
    assert sorted(got) == sorted({(a, "liked", p) for a, p, _ in likes} - {e for e in edges})
    spark.createDataFrame([], "author_id long, paper_id long").write.parquet(known)
    stream = spark.readStream.schema("author_id long, paper_id long").parquet(known)
    plan = new_likes(like_stream(spark, source), stream)._jdf.queryExecution().analyzed().toString()
    assert "Deduplicate" in plan and "InPandas" not in plan and "Python" not in plan


def test_a_first_batch_that_failed_is_run_again(spark):
    """What is stored was written, its batch not committed: it still comes before the likes, from the same files."""
    source, sink, checkpoint = (scratch_path(spark, n) for n in ("events", "likes", "state"))
    land(spark, source, [(1, 10, 0), (1, 11, 0)], 0)
    stored = spark.createDataFrame([(1, "liked", 10)], EDGES)
    blocked = stored.withColumn("paper_id", F.raise_error(F.lit("lost")).cast("long"))
    with pytest.raises(Exception, match="lost"):
        run_stateful_likes(spark, source, blocked, sink, checkpoint)
    run_stateful_likes(spark, source, stored, sink, checkpoint)
    assert [tuple(r) for r in spark.read.schema(EDGES).parquet(sink).collect()] == [(1, "liked", 11)]
