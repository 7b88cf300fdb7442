"""Byte-level BPE encoding and decoding through a sentencepiece model built from a rank file.

The model is serialised directly from the vocabulary: each token's bytes become characters, one for
each byte, and the piece's score is its negative rank; normalisation is the identity. A text is split by the
tokenizer's pattern; each match is encoded by itself, and decoding maps pieces back to bytes.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faunaflow.llm.common import documents

#: Byte b is the character of code point FIRST + b: no white space and no control character among them.
FIRST = 0x100
#: Distinct matches that a task remembers before it starts anew.
REMEMBERED = 500_000


def read_ranks(path: str) -> list[bytes]:
    """Tokens of a tiktoken rank file, by rank; ranks must run from 0 without gaps."""
    with open(path, "rb") as f:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, f)}
    return [ranks[i] for i in range(len(ranks))]


def mapped(token: bytes) -> str:
    return "".join(chr(FIRST + b) for b in token)


def unmapped(piece: str) -> bytes:
    return bytes(ord(c) - FIRST for c in piece)


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _field(number: int, value: int | float | bytes) -> bytes:
    """One protocol buffer field: a varint, a 32-bit float or bytes."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    return _varint(number << 3) + _varint(value)


def model_bytes(tokens: list[bytes]) -> bytes:
    """A sentencepiece BPE model whose piece i is token i; the unknown piece comes last."""
    pieces = [_field(1, _field(1, mapped(t).encode()) + _field(2, -float(i)) + _field(3, 1)) for i, t in enumerate(tokens)]
    pieces.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)))
    n = len(tokens)
    # model type BPE, vocabulary size, unknown id; no begin, end or padding piece (-1 as 64 bits)
    none = (1 << 64) - 1
    trainer = _field(3, 2) + _field(4, n + 1) + _field(40, n) + _field(41, none) + _field(42, none) + _field(43, none)
    # identity normaliser: no added prefix, no removed or escaped white space
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normalizer)


class Codec:
    """Encodes texts to little-endian unsigned 32-bit ids and back."""

    def __init__(self, tokens: list[bytes], model: bytes, pattern: str):
        import regex
        import sentencepiece

        self.tokens, self.ranks = tokens, {t: i for i, t in enumerate(tokens)}
        self.split = regex.compile(pattern).findall
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.by_id = [unmapped(self.pieces.id_to_piece(i)) for i in range(len(tokens))]
        self.known: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        matches = self.split(text)
        if fresh := [m for m in set(matches) if m not in self.known]:
            if len(self.known) > REMEMBERED:
                self.known.clear()
                fresh = list(set(matches))
            raw = [m.encode() for m in fresh]
            # a match that is a token itself stays whole, though merges might not reach it
            whole = [self.ranks.get(r) for r in raw]
            merged = iter(self.pieces.encode([mapped(r) for r, w in zip(raw, whole) if w is None], out_type=int))
            for match, rank in zip(fresh, whole):
                ids = [rank] if rank is not None else next(merged)
                self.known[match] = struct.pack(f"<{len(ids)}I", *ids)
        return b"".join(map(self.known.__getitem__, matches))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.by_id.__getitem__, memoryview(ids).cast("I")))


def encode_decode(df: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, decoded: the ids of every whole text as bytes, 32-bit little-endian, and their decoding.

    Null and empty texts have no ids. Rows come as they are, repeated and null ids included; other
    columns are not read. The vocabulary, which does not grow with the data, is read on the driver
    and sent to the executors with the model.
    """
    docs = documents(df, id_col, text_col)
    tokens = read_ranks(rank_path)
    sent = df.sparkSession.sparkContext.broadcast((tokens, model_bytes(tokens)))
    schema = docs.select("doc_id", F.lit(b"").alias("ids"), F.lit(b"").alias("decoded")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(*sent.value, pattern)
        for batch in batches:
            ids, decoded = [], []
            for text in batch.column("text"):
                ids.append(codec.encode(text.as_py()))
                decoded.append(codec.decode(ids[-1]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())], ["doc_id", "ids", "decoded"]
            )

    return docs.mapInArrow(run, schema)
