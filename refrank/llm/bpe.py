"""Byte-level BPE through sentencepiece.

The rank file becomes a sentencepiece BPE model: each token's bytes are mapped one to one onto printable
characters, its piece is scored by its negative rank, and normalisation is the identity, so sentencepiece
merges exactly the pairs that the ranks order. Texts are cut into pre-tokens by the public pattern, each
pre-token is byte-mapped and encoded alone, and decoding maps ids back to their bytes.

A pre-token never crosses from one space-led chunk into the next, so ids are memoised per chunk: word
frequencies make nearly every chunk a dictionary hit.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame, SparkSession

from refrank.llm.base import id_text

# The white space class of the pre-token pattern, and the chunks that it never crosses.
SPACE = "\t-\r \x85\xa0  -     　"
CHUNK = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
MEMO_CHARS = 48  # longer chunks are encoded each time
MEMO_SIZE = 300_000  # entries per worker process; a full memo starts anew


def read_ranks(lines: bytes) -> list[bytes]:
    """Token bytes by rank; ranks are dense from zero."""
    ranks = {}
    for line in lines.splitlines():
        if line:
            token, rank = line.split()
            ranks[int(rank)] = base64.b64decode(token)
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks must be dense from zero")
    return [ranks[k] for k in range(len(ranks))]


def byte_letters() -> list[str]:
    """A printable, non-space character for each byte: itself where it is one, else from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = itertools.count(0x100)
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out + bytes([n]))


def _field(number: int, value: bytes | int | float) -> bytes:
    """One protocol buffer field: length-delimited, varint or 32-bit float by the value's type."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def model_proto(tokens: list[bytes]) -> bytes:
    """A serialised sentencepiece BPE model whose piece ids are the ranks; the unknown piece comes last."""
    letters = byte_letters()
    out = bytearray()
    for rank, token in enumerate(tokens):
        piece = "".join(letters[b] for b in token).encode()
        out += _field(1, _field(1, piece) + _field(2, float(-rank)) + _field(3, 1))
    out += _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    off = (1 << 64) - 1  # -1: no such piece
    out += _field(2, _field(3, 2) + _field(40, len(tokens)) + _field(41, off) + _field(42, off) + _field(43, off))
    out += _field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0))
    return bytes(out)


class Codec:
    """Encoder and decoder of one vocabulary; one per worker process."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens = tokens
        self.whole = {t: k for k, t in enumerate(tokens)}
        self.letters = byte_letters()
        self.split = regex.compile(pattern)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_proto(tokens))
        self.memo: dict[str, bytes] = {}

    def _chunk(self, chunk: str) -> bytes:
        ids: list[int] = []
        for part in self.split.findall(chunk):
            raw = part.encode("utf-8", "surrogatepass")
            known = self.whole.get(raw)
            if known is not None:
                ids.append(known)
            else:
                ids += self.model.encode("".join(map(self.letters.__getitem__, raw)))
        out = struct.pack(f"<{len(ids)}I", *ids)
        if len(chunk) <= MEMO_CHARS:
            if len(self.memo) >= MEMO_SIZE:
                self.memo.clear()
            self.memo[chunk] = out
        return out

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        get, miss = self.memo.get, self._chunk
        return b"".join([get(c) or miss(c) for c in CHUNK.findall(text)])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_CODECS: dict[tuple[int, str], Codec] = {}


def _codec(lines: bytes, pattern: str) -> Codec:
    key = (hash(lines), pattern)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(read_ranks(lines), pattern)
    return _CODECS[key]


def read_vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _mapped(docs: DataFrame, lines: bytes, pattern: str, schema: str, row) -> DataFrame:
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(lines)  # a vocabulary file: its size does not depend on the data
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value, pattern)
        for b in batches:
            rows = [row(codec, t) for t in b.column(1).to_pylist()]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), *(pa.array(c) for c in zip(*rows, strict=True))], ["doc_id", *names]
                )

    return id_text(docs).mapInArrow(run, f"doc_id long, {schema}")


def encode_documents(docs: DataFrame, lines: bytes, pattern: str) -> DataFrame:
    """(doc_id, ids binary, decoded binary) per input row: little-endian unsigned 32-bit ids of the whole
    text and the bytes that they decode to. An empty or NULL text has no ids."""

    def row(codec: Codec, text: str):
        ids = codec.encode(text)
        return ids, codec.decode(ids)

    return _mapped(docs, lines, pattern, "ids binary, decoded binary", row)


def encode_digests(docs: DataFrame, lines: bytes, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) per input row; as :func:`encode_documents`, with the
    digests taken where the ids are made."""

    def row(codec: Codec, text: str):
        ids = codec.encode(text)
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest()

    return _mapped(docs, lines, pattern, "n_tokens long, ids_sha256 string, decoded_sha256 string", row)
