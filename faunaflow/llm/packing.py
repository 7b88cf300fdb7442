"""Lexical retrieval packing of token sequences.

Each document's tokens are cut into full windows, which need no neighbours, and a part that is shorter.
The parts are dealt out by content: their rarest tokens are their place in a range partitioning, so
parts that share rare words stand together wherever they were stored, however many there are; equal
places are told apart by a hash, so no group of copies is one task's. Consecutive parts form a shard
with its own BM25 inverted index. A seed asks it with all its terms; unused neighbours fill the seed's
window in the order of their scores, and the last one is cut where the window ends: what is left of it is the
next seed. What a shard has at its end is cut into sequences of powers of two, which need no padding.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faunaflow.llm.common import documents, written

WINDOW = 1024
END = 0
#: Pieces in an Arrow batch: 2 MB of ids.
ROWS = 512
K1, B = 1.2, 0.75
#: A term in more than one of so many parts of a shard has a row of weights.
MANY = 8
#: Parts of a shard.
SHARD = 2048
#: Rarest tokens that make a part's place, and bits for each.
RAREST, BITS = 3, 20
#: Longer texts are looked through for white space that the fast encoder's pattern cannot pass.
LONG_TEXT, LONG_SPACE = 200_000, r"\s{100000}"


class Tokens:
    """Ids of a tokenizers file of byte-level BPE, then the end id, as tokenizers gives them.

    Where every merge's id follows its rank, tiktoken runs the same merges several times faster. Texts
    with a string of an added token, or with very long white space, are left to tokenizers; so is
    any other file. The file is looked through once, on the driver; a worker loads what it needs.
    """

    def __init__(self, file: str, pattern: str):
        spec = json.loads(file)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        added = [t["content"] for t in spec.get("added_tokens", [])]
        plain = {k: v for k, v in vocab.items() if k not in set(added)}
        ordered = len(plain) == 256 + len(pairs) and all(vocab.get(a + b) == 256 + i for i, (a, b) in enumerate(pairs))
        self.file, self.pattern, self.ranks = file, pattern, None
        if ordered and spec["pre_tokenizer"]["type"] == "ByteLevel" and not spec["pre_tokenizer"].get("add_prefix_space") and not spec.get("normalizer"):
            from tokenizers.pre_tokenizers import ByteLevel

            # printable bytes stand for themselves, the others follow from code point 256 on, in order
            shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
            codes = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
            assert codes.keys() == set(ByteLevel.alphabet())
            self.ranks = {bytes(codes[c] for c in k): v for k, v in plain.items()}
        self.added = re.compile("|".join(map(re.escape, added)) or r"(?!)")
        self.long_space = re.compile(LONG_SPACE)

    @cached_property
    def fast(self):
        import tiktoken

        return tiktoken.Encoding("packing", pat_str=self.pattern, mergeable_ranks=self.ranks, special_tokens={}).encode_ordinary

    @cached_property
    def own(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_str(self.file)

    def __call__(self, text: str) -> np.ndarray:
        slow = self.ranks is None or self.added.search(text) or (len(text) > LONG_TEXT and self.long_space.search(text))
        ids = self.own.encode(text, add_special_tokens=False).ids if slow else self.fast(text)
        ids.append(END)
        return np.frombuffer(array("I", ids), dtype=np.uint32)


def place(ids: np.ndarray) -> int:
    """The rarest distinct tokens, rarest first, as one number; a later id of a BPE vocabulary is rarer."""
    ids = np.minimum(ids, (1 << BITS) - 1)
    last = np.unique(np.partition(ids, -8 * RAREST)[-8 * RAREST :] if len(ids) > 8 * RAREST else ids)
    last = (last if len(last) >= RAREST else np.unique(ids))[: -RAREST - 1 : -1].tolist()
    return sum(t << BITS * (RAREST - 1 - i) for i, t in enumerate(last))


class Index:
    """A BM25 inverted index over the token arrays of one shard."""

    def __init__(self, parts: list[np.ndarray]):
        n, sizes = len(parts), np.array([len(p) for p in parts])
        owner = np.repeat(np.arange(n, dtype=np.int64), sizes)
        keys, tf = np.unique(owner << 32 | np.concatenate(parts).astype(np.int64), return_counts=True)
        doc = keys >> 32
        _, self.of = np.unique(keys & 0xFFFFFFFF, return_inverse=True)
        self.df = np.bincount(self.of)
        idf = np.log1p((n - self.df + 0.5) / (self.df + 0.5))
        weight = idf[self.of] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[doc] / sizes.mean()))
        # terms of many parts have a row of weights by part, others a list of parts
        self.row = np.where(self.df > n // MANY, np.cumsum(self.df > n // MANY) - 1, -1)
        many = self.row[self.of] >= 0
        self.rows = np.zeros((int(self.row.max()) + 1, n))
        self.rows[self.row[self.of[many]], doc[many]] = weight[many]
        by_term = np.argsort(self.of, kind="stable")
        self.docs, self.weights = doc[by_term], weight[by_term]
        self.first = np.r_[0, np.cumsum(self.df)]
        self.own, self.n = np.r_[0, np.cumsum(np.bincount(doc, minlength=n))], n

    def scores(self, seed: int) -> np.ndarray:
        """BM25 scores of all parts for all terms of the seed."""
        terms = self.of[self.own[seed] : self.own[seed + 1]]
        many = self.row[terms]
        terms = terms[(many < 0) & (self.df[terms] > 1)]
        each = self.df[terms]
        ends = np.cumsum(each)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.first[terms] - ends + each, each)
        return np.bincount(self.docs[at], self.weights[at], self.n) + self.rows[many[many >= 0]].sum(0)


def pack_shard(parts: list[np.ndarray], window: int) -> Iterator[list[tuple[int, int, int]]]:
    """Sequences of (part, start in it, length): all of full windows but, at the end, powers of two."""
    if not parts:
        return
    index, at = Index(parts), np.zeros(len(parts), dtype=np.int64)
    size = np.array([len(p) for p in parts])
    free = np.ones(len(parts), dtype=bool)
    rest: list[tuple[int, int, int]] = []
    seed = 0
    while free[seed]:
        free[seed] = False
        got, room = [(seed, int(at[seed]), int(size[seed] - at[seed]))], window - int(size[seed] - at[seed])
        others = np.flatnonzero(free)
        following = int(others[0]) if len(others) else seed
        if room and len(others):
            for d in others[np.argsort(-index.scores(seed)[others], kind="stable")].tolist():
                length = min(room, int(size[d] - at[d]))
                got.append((d, int(at[d]), length))
                at[d], room = at[d] + length, room - length
                free[d] = at[d] < size[d]
                if not room:
                    # the part that was cut goes on, else the next one in the order of content
                    following = d if free[d] else int(np.argmax(free))
                    break
        seed = following
        if room:
            rest = got
        else:
            yield got
    total = sum(x[2] for x in rest)
    while total:
        room = 1 << total.bit_length() - 1
        total, got = total - room, []
        while room:
            d, start, length = rest.pop(0)
            if length > room:
                rest.insert(0, (d, start + room, length - room))
                length = room
            got.append((d, start, length))
            room -= length
        yield got


def _encoded(docs: DataFrame, tokens, window: int) -> DataFrame:
    """doc_id, start, length, ids, doc_tokens, sequence_id (of full windows; null for shorter parts), place."""
    names = ["start", "length", "ids", "doc_tokens", "sequence_id", "place"]
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *(T.StructField(n, T.BinaryType() if n == "ids" else T.LongType()) for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, rows = tokens.value, TaskContext.get().partitionId() << 36, []

        def batch_of(kind: pa.DataType) -> pa.RecordBatch:
            columns = list(zip(*rows[:ROWS]))
            del rows[:ROWS]
            return pa.RecordBatch.from_arrays([pa.array(c, kind if n == "doc_id" else pa.binary() if n == "ids" else pa.int64()) for n, c in zip(schema.names, columns)], schema.names)

        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = encode(text.as_py())
                full = len(ids) // window * window
                for start in range(0, full, window):
                    rows.append((doc, start, window, ids[start : start + window].tobytes(), len(ids), task, None))
                    task += 1
                if full < len(ids):
                    rows.append((doc, full, len(ids) - full, ids[full:].tobytes(), len(ids), None, place(ids[full:])))
                while len(rows) >= ROWS:
                    yield batch_of(kind)
            if rows:
                yield batch_of(kind)

    return docs.mapInArrow(run, schema)


def pack(
    df: DataFrame,
    tokenizer_path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    shard: int = SHARD,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (32-bit little-endian), doc_tokens, sequence_id, offset.

    Every token of every document, with the end id 0 after its text, lies in exactly one piece; the
    pieces of a sequence follow each other from offset 0. Null and empty texts have the end id alone.
    Every row is a document of its own, repeated rows and null ids included; ties of a score go by the
    order of content. An empty table gives no rows; other columns are not read. ``window`` must be a
    power of two. Texts are encoded once, into a table in the shared folder.
    """
    docs = documents(df, id_col, text_col)
    with open(tokenizer_path, encoding="utf-8") as f:
        tokens = df.sparkSession.sparkContext.broadcast(Tokens(f.read(), pattern))
    pieces = written(_encoded(docs, tokens, window), "zstd")
    columns = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id"]
    whole = pieces.where("sequence_id is not null").select(*columns, F.lit(0).cast("long").alias("offset"))
    parts = pieces.where("sequence_id is null").select("place", F.xxhash64("doc_id", "start").alias("salt"), "doc_id", "start", "ids", "doc_tokens")
    parts = parts.repartitionByRange("place", "salt").sortWithinPartitions("place", "salt").drop("place", "salt")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # beyond the numbers of full windows
        sequence = 1 << 60 | TaskContext.get().partitionId() << 36
        held: list[tuple] = []

        def packed(kind: pa.DataType) -> Iterator[pa.RecordBatch]:
            nonlocal sequence
            rows: list[tuple] = []
            ids = [np.frombuffer(h[2], dtype="<u4") for h in held]
            for got in pack_shard(ids, window):
                offset = 0
                for i, start, length in got:
                    doc, done, _, total = held[i]
                    rows.append((doc, done + start, length, ids[i][start : start + length].tobytes(), total, sequence, offset))
                    offset += length
                sequence += 1
            held.clear()
            for at in range(0, len(rows), ROWS):
                columns_ = zip([kind, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()], zip(*rows[at : at + ROWS]))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for k, c in columns_], [*columns, "offset"])

        kind = None
        for batch in batches:
            kind = batch.schema.field("doc_id").type
            held += zip(*(batch.column(n).to_pylist() for n in ("doc_id", "start", "ids", "doc_tokens")))
            while len(held) >= shard:
                later = held[shard:]
                del held[shard:]
                yield from packed(kind)
                held += later
        if held:
            yield from packed(kind)

    return whole.unionByName(parts.mapInArrow(run, whole.schema))
