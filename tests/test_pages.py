"""Landed pages through the data source: every record, typed names, loud failures, batch and stream."""

import json

import pytest
from pyspark.sql import functions as F

from refrank.sources import pages as P
from refrank.sources.store import scratch_path


def paper(i, **more):
    return {"paperId": f"p{i}", "title": f"T {i} é😀 \"]}},{{[", "abstract": None, "year": 2000 + i % 20, "referenceCount": i, "citationCount": 2 * i,
            "influentialCitationCount": 0, "authors": [{"authorId": "a", "name": "N"}, {"authorId": None, "name": "M"}], "references": [{"paperId": "x"}], "extra": {"k": [1]}, **more}


def parts(data, size):
    return (data[a : a + size] for a in range(0, len(data), size))


@pytest.mark.parametrize("size", [1, 2, 7, 100, 1 << 20])
def test_records_come_whole_from_chunks_of_any_size(size):
    records = [paper(i) for i in range(20)]
    for text in (json.dumps(records), json.dumps(records, indent=2, ensure_ascii=False), "﻿ [ ]\n", "[]"):
        want = json.loads(text.lstrip("﻿"))
        assert list(P.array_records(parts(text.encode(), size))) == want


@pytest.mark.parametrize("text", ["", " ", "[", "[{}", "[{},", "[{},]", "[{}] x", "[{}]]", "{}", "[1]", "[null]", '[{"a": }]', '[{"a": 1} {"b": 2}]', '[{"a": "cut', "[,{}]", "[[]]"])
@pytest.mark.parametrize("size", [1, 1000])
def test_malformed_pages_fail(text, size):
    with pytest.raises(P.BadPage):
        list(P.array_records(parts(text.encode(), size)))


def test_memory_is_bounded_by_a_record():
    held = []

    def stream():
        yield b"["
        for i in range(3000):
            yield (", " if i else "").encode() + json.dumps(paper(i, title="x" * 1000)).encode()
            held.append(i)
        yield b"]"

    for n, _ in enumerate(P.array_records(stream())):
        assert held == [] or held[-1] <= n + 2  # records leave as they come; none waits for the end
    assert n == 2999
    with pytest.raises(P.BadPage, match="too long"):
        list(P.array_records(parts(json.dumps([paper(1, title="y" * 5000)]).encode(), 100), most=1000))


@pytest.fixture
def folder(spark):
    path = scratch_path(spark, "pages").removeprefix("file:")
    P.pafs.LocalFileSystem().create_dir(path, recursive=True)

    def land(name, text):
        with open(f"{path}/{name}", "w", encoding="utf-8") as f:
            f.write(text if isinstance(text, str) else json.dumps(text))

    land.path = path
    return land


def test_batch_read_with_typed_names(spark, folder):
    folder("deep learning-0-100.json", [paper(i) for i in range(3)])
    folder("a-b-100-250.json", [paper(7)])
    folder("loose.json", [])
    folder("other.json", [paper(9, year=None)])
    folder("_SUCCESS", "no json")
    df = P.read_pages(spark, folder.path)
    assert dict(df.dtypes)["offset_from"] == "bigint" and df.schema == P.PAGE_SCHEMA
    rows = sorted((r.query or "", r.offset_from, r.offset_to, r.pos, r.paperId, r.year, len(r.authors)) for r in df.collect())
    assert rows == [
        ("", None, None, 0, "p9", None, 2), ("a-b", 100, 250, 0, "p7", 2007, 2),
        ("deep learning", 0, 100, 0, "p0", 2000, 2), ("deep learning", 0, 100, 1, "p1", 2001, 2), ("deep learning", 0, 100, 2, "p2", 2002, 2),
    ]
    assert df.where(F.col("query") == "a-b").first().title == paper(7)["title"]


@pytest.mark.parametrize("text", ['[{"paperId": "p1"}, {"paperId": "p2"', '[{"paperId": "p1", "year": "two"}]', '[{"paperId": "p1", "year": true}]', '[{"paperId": 5}]', "not json"])
def test_bad_pages_fail_the_read(spark, folder, text):
    folder("q-0-100.json", [paper(1)])
    folder("q-100-200.json", text)
    with pytest.raises(Exception, match="q-100-200"):
        P.read_pages(spark, folder.path).collect()


def test_stream_takes_each_page_once(spark, folder):
    sink, state = scratch_path(spark, "sink"), scratch_path(spark, "state")

    def run():
        q = P.stream_pages(spark, folder.path).select("paperId", "query").writeStream.format("parquet")
        q.option("path", sink).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        return sorted(r.paperId for r in spark.read.schema("paperId string, query string").parquet(sink).collect())

    folder("q-0-2.json", [paper(1), paper(2)])
    assert run() == ["p1", "p2"]
    folder("q-2-4.json", [paper(3), paper(4)])
    folder("b-0-1.json", [paper(5)])
    assert run() == ["p1", "p2", "p3", "p4", "p5"]
    assert run() == ["p1", "p2", "p3", "p4", "p5"]


def test_landed_pages_are_read_back(spark):
    path = scratch_path(spark, "landed")
    df = spark.range(250).select(F.col("id").cast("string").alias("paperId"), F.lit(2000).alias("year"), F.col("id").alias("n"))
    assert P.land_pages(df, path, "big query", "n", 100) == 3
    back = P.read_pages(spark, path)
    assert [tuple(r) for r in back.groupBy("query", "offset_from", "offset_to").count().orderBy("offset_from").collect()] == [
        ("big query", 0, 100, 100), ("big query", 100, 200, 100), ("big query", 200, 300, 50)
    ]
    assert back.where(F.col("paperId").cast("long") != F.col("offset_from") + F.col("pos")).count() == 0


def test_small_pages_share_a_task_and_large_ones_do_not():
    small = P.together([(i, f"p{i}", 1000) for i in range(1000)])
    assert len(small) == -(-1000 // P.TOGETHER) and [u for p in small for u in p.uris] == [f"p{i}" for i in range(1000)]
    assert [p.uris for p in P.together([(0, "a", P.TASK_BYTES), (1, "b", 5), (2, "c", 5)])] == [["a"], ["b", "c"]]
    assert P.together([]) == []
