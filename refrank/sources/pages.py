"""Landed pages as a Spark data source, in batch and as a stream.

A page is one file with one JSON array of paper records, named ``<query>-<from>-<to>.json``. The reader decodes the
array record by record from a sliding buffer and hands Arrow batches to Spark, so a page may be larger than
any task's memory; a record may not (``maxRecordBytes``). A file that ends early, goes on after its array, holds
something else than objects or a value of another type fails the read; it never becomes missing or NULL papers.

``spark.dataSource.register(PaperPages)``, then ``spark.read.format("paper_pages").load(folder)`` or
``spark.readStream.format("paper_pages").load(folder)``. Paths are what ``pyarrow.fs`` resolves: shared folders, hdfs, s3, gs.
"""

from __future__ import annotations

import codecs
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from refrank.schemas import PAPER_JSON
from refrank.sources.json_papers import PAGE_NAME

FORMAT = "paper_pages"
CHUNK = 1 << 20  # bytes read at a time
BATCH = 1000  # records of an Arrow batch
TOGETHER = 64  # pages of a task at most
TASK_BYTES = 1 << 23  # a task takes no further page beyond
MAX_RECORD = 1 << 26
PLACE = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("query", T.StringType()),
        T.StructField("offset_from", T.LongType()),
        T.StructField("offset_to", T.LongType()),
        T.StructField("pos", T.LongType()),
    ]
)
PAGE_SCHEMA = T.StructType([*PLACE.fields, *PAPER_JSON.fields])
DECODER = json.JSONDecoder()
BLANK = " \t\r\n"


class BadPage(ValueError):
    pass


def array_records(chunks: Iterator[bytes], most: int = MAX_RECORD) -> Iterator[dict]:
    """The objects of one JSON array, decoded as its bytes arrive; at most ``most`` characters are held."""
    decode = codecs.getincrementaldecoder("utf-8-sig")("strict").decode
    text, at, ended, state = "", 0, False, "open"  # open [, first, more (after a record), value (after a comma), closed
    while True:
        while at < len(text) and text[at] in BLANK:
            at += 1
        if at < len(text):
            c = text[at]
            if state == "open" and c == "[":
                at, state = at + 1, "first"
                continue
            if state in ("first", "more") and c == "]":
                at, state = at + 1, "closed"
                continue
            if state == "more" and c == ",":
                at, state = at + 1, "value"
                continue
            if state in ("first", "value") and c == "{":
                try:
                    record, at = DECODER.raw_decode(text, at)
                except json.JSONDecodeError as wrong:
                    if ended or len(text) - at > most:
                        raise BadPage(f"a record is malformed, cut off or too long: {wrong}") from wrong
                else:
                    yield record
                    state = "more"
                    continue
            else:
                raise BadPage(f"{c!r} where the array has {state!r}")
        if ended:
            if state != "closed":
                raise BadPage("the file ends before its array does")
            return
        # a record that spans chunks is tried again with twice as much, so long ones cost little more
        need, parts = max(1, len(text) - at), []
        while need > 0:
            chunk = next(chunks, b"")
            parts.append(decode(chunk, final=not chunk))
            need -= len(chunk)
            if not chunk:
                ended = True
                break
        text, at = text[at:] + "".join(parts), 0


def _checked(value: object, kind: T.DataType) -> object:
    """``value`` if it is of the type, which Arrow alone would not always say (it reads true as 1)."""
    if isinstance(value, bool) and isinstance(kind, T.IntegralType):
        raise BadPage("a truth value where a number belongs")
    return value


def _name(path: str) -> tuple[str | None, int | None, int | None]:
    found = re.match(PAGE_NAME, path.rsplit("/", 1)[-1])
    return (found[1], int(found[2]), int(found[3])) if found else (None, None, None)


@dataclass
class Pages(InputPartition):
    uris: list[str]


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path in it; "file:/..." as Spark writes it is a plain path, and blanks and the like are no escapes."""
    if path.startswith("file:"):
        path = re.sub(r"^file:/*", "/", path)
    if path.startswith("/"):
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(path)


def list_pages(folder: str) -> list[tuple[int, str]]:
    """(modification time in ns, uri) of the files below a folder, hidden and marker files aside."""
    return [found[:2] for found in _listed(folder)]


def _listed(folder: str) -> list[tuple[int, str, int]]:
    """The same with the size of each."""
    system, root = _opened(folder)
    # what from_uri took off: "file://", "hdfs://host", or nothing of a plain path
    head = folder[: folder.index(root)] if root in folder else ""
    out = []
    for f in system.get_file_info(pafs.FileSelector(root, recursive=True)):
        below = f.path[len(root) :].strip("/").split("/")
        if f.type == pafs.FileType.File and not any(p[0] in "_." and "=" not in p for p in below):
            out.append((f.mtime_ns or 0, head + f.path, f.size or 0))
    return sorted(out)


def together(pages: list[tuple[int, str, int]]) -> list[Pages]:
    """Small pages share a task, so that tasks grow with the bytes and not with the files."""
    out, held = [], 0
    for _, uri, size in pages:
        if not out or held >= TASK_BYTES or len(out[-1].uris) >= TOGETHER:
            out.append(Pages([]))
            held = 0
        out[-1].uris.append(uri)
        held += size
    return out


def read_page(uri: str, schema: T.StructType, most: int) -> Iterator[pa.RecordBatch]:
    """The records of one page in order, with the name's query and offsets and their position."""
    system, path = _opened(uri)
    arrow = to_arrow_schema(schema)
    fields = [f for f in schema.fields if f.name not in PLACE.names]
    query, low, high = _name(uri)
    rows: list[dict] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(rows, schema=arrow)

    pos = 0
    with system.open_input_stream(path) as stream:
        chunks = iter(lambda: stream.read(CHUNK), b"")
        try:
            for record in array_records(chunks, most):
                row = {f.name: _checked(record.get(f.name), f.dataType) for f in fields}
                rows.append({"file": uri, "query": query, "offset_from": low, "offset_to": high, "pos": pos, **row})
                pos += 1
                if len(rows) == BATCH:
                    yield batch()
                    rows.clear()
            if rows:
                yield batch()
        except (BadPage, UnicodeDecodeError, pa.ArrowException) as wrong:
            raise BadPage(f"{uri}, from record {pos - len(rows)} on: {wrong}") from wrong


class PagesReader(DataSourceReader):
    def __init__(self, folder: str, schema: T.StructType, most: int):
        self.folder, self.schema, self.most = folder, schema, most

    def partitions(self) -> list[Pages]:
        return together(_listed(self.folder))

    def read(self, partition: Pages) -> Iterator[pa.RecordBatch]:
        for uri in partition.uris if partition is not None else ():
            yield from read_page(uri, self.schema, self.most)


class PagesStream(DataSourceStreamReader):
    """Pages in order of arrival. An offset is the newest page taken, so pages are landed whole, by a rename."""

    def __init__(self, folder: str, schema: T.StructType, most: int):
        self.folder, self.schema, self.most = folder, schema, most

    def initialOffset(self) -> dict:
        return {"mtime": -1, "uri": ""}

    def latestOffset(self) -> dict:
        pages = list_pages(self.folder)
        return {"mtime": pages[-1][0], "uri": pages[-1][1]} if pages else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        low, high = ((o["mtime"], o["uri"]) for o in (start, end))
        return together([p for p in _listed(self.folder) if low < p[:2] <= high])

    def read(self, partition: Pages) -> Iterator[pa.RecordBatch]:
        for uri in partition.uris:
            yield from read_page(uri, self.schema, self.most)

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


class PaperPages(DataSource):
    """Options: ``path``, the folder; ``maxRecordBytes``, the longest record."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> T.StructType:
        return PAGE_SCHEMA

    def _arguments(self, schema: T.StructType) -> tuple[str, T.StructType, int]:
        return self.options["path"], schema, int(self.options.get("maxRecordBytes", MAX_RECORD))

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return PagesReader(*self._arguments(schema))

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return PagesStream(*self._arguments(schema))


def read_pages(spark: SparkSession, folder: str, **options: object) -> DataFrame:
    spark.dataSource.register(PaperPages)
    return spark.read.format(FORMAT).options(**options).load(folder)


def stream_pages(spark: SparkSession, folder: str, **options: object) -> DataFrame:
    spark.dataSource.register(PaperPages)
    return spark.readStream.format(FORMAT).options(**options).load(folder)


def land_pages(df: DataFrame, folder: str, query: str, number: str, page_size: int = 100) -> int:
    """Land ``df`` (camelCase paper records and a column ``number`` = 0, 1, ...) as pages of ``page_size`` records named
    as the search interface names them. A repeated task writes the same file again. Returns the number of pages."""
    cols = [c for c in df.columns if c != number]
    page = F.floor(F.col(number) / F.lit(page_size)).alias("page")
    rows = df.select(page, F.col(number).alias("at"), F.to_json(F.struct(*cols)).alias("record"))

    def land(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        k = table["page"][0].as_py()
        system, root = _opened(folder)
        system.create_dir(root, recursive=True)
        name = f"{query}-{k * page_size}-{(k + 1) * page_size}.json"
        with system.open_output_stream(f"{root}/.{name}") as out:
            out.write(("[" + ",\n".join(table["record"].to_pylist()) + "]").encode())
        system.move(f"{root}/.{name}", f"{root}/{name}")
        return pa.table({"page": pa.array([k], pa.int64())})

    return rows.groupBy("page").applyInArrow(land, "page long").count()
