import base64
import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import AWKWARD, corpus, frame
from hypothesis import given, settings
from hypothesis import strategies as st

from faunaflow.llm import bpe, packing

P = pytest.importorskip("public_tokenizers")
RANKS = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def codec():
    tokens = bpe.read_ranks(RANKS)
    return bpe.Codec(tokens, bpe.model_bytes(tokens), P.PATTERN)


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="ab 'tsre\n\t1é\x1c\x1f\x85  ß", max_size=60)))
def test_codec_equals_tiktoken(codec, reference, text):
    ids = codec.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(text)
    assert codec.decode(ids) == text.encode()


def test_bpe_of_a_table(spark, reference):
    rows = AWKWARD + [(100 + i, t) for i, t in corpus(30)]
    got = bpe.encode_decode(frame(spark, rows), RANKS, P.PATTERN).collect()
    assert sorted((r.doc_id or 0, bytes(r.decoded)) for r in got) == sorted((i or 0, (t or "").encode()) for i, t in rows)
    for r in got:
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == reference.encode_ordinary(bytes(r.decoded).decode())
    assert bpe.encode_decode(frame(spark, []), RANKS, P.PATTERN).collect() == []


JSON = P.path("byte_bpe_50k.json")


@pytest.mark.parametrize("shard", [2048, 7])
def test_packing_is_whole_and_dense(spark, shard):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(JSON)
    rows = [(i if i is not None else -1, t) for i, t in dict(AWKWARD).items()] + [(100 + i, t) for i, t in corpus(80, words=300)] + [(500, "ab " * 3000)]
    rows += [(501, "ab <|endoftext|> cd"), (502, "<|endoftext|>" * 3 + "<|endof text|>"), (503, " " * 1_000_000), (504, "x" + "\n" * 300_000 + "<|endoftext|>"), (505, "a" * 300_000)]
    got = packing.pack(frame(spark, rows), JSON, P.PATTERN, shard=shard).collect()
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        docs[r.doc_id].append((r.start, np.frombuffer(bytes(r.ids), "<u4").tolist(), r.doc_tokens, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert docs.keys() == {i for i, _ in rows}
    for i, t in rows:
        want = own.encode(t or "", add_special_tokens=False).ids + [0]
        joined = []
        for start, ids, total, length in sorted(docs[i]):
            assert start == len(joined) and total == len(want) and length == len(ids)
            joined += ids
        assert joined == want
    padding = 0
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
        padding += 0 if at & (at - 1) == 0 else packing.WINDOW - at
    assert padding == 0


def plain_bm25(parts, seed):
    """Scores by the formula, from counts."""
    counts = [Counter(p.tolist()) for p in parts]
    n, mean = len(parts), sum(map(len, parts)) / len(parts)
    out = []
    for c, p in zip(counts, parts):
        s = 0.0
        for t in set(counts[seed]) & set(c):
            df = sum(t in x for x in counts)
            if df > 1:
                s += math.log(1 + (n - df + 0.5) / (df + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * len(p) / mean))
        out.append(s)
    return out


def test_neighbours_are_those_of_plain_bm25():
    rng = np.random.default_rng(1)
    parts = [(rng.zipf(1.3, size=rng.integers(1, 200)) % 500).astype(np.uint32) for _ in range(60)]
    index = packing.Index(parts)
    for seed in range(0, 60, 7):
        assert np.allclose(index.scores(seed), plain_bm25(parts, seed))
    left = {i: len(p) for i, p in enumerate(parts)}
    whole = [got for got in packing.pack_shard(parts, 256) if sum(x[2] for x in got) == 256]
    assert len(whole) == sum(left.values()) // 256
    for got in whole:
        seed = got[0][0]
        scores = plain_bm25(parts, seed)
        del left[seed]
        for d, _, length in got[1:]:
            assert scores[d] >= max(scores[i] for i in left) - 1e-9
            left[d] -= length
            if not left[d]:
                del left[d]


def test_packing_prefers_lexical_neighbours():
    rng = np.random.default_rng(0)
    topics = [rng.integers(1000 * k, 1000 * k + 60, size=(8, 256)).astype(np.uint32) for k in range(1, 9)]
    parts = [p for i in range(8) for p in (t[i] for t in topics)]
    for got in packing.pack_shard(parts, 1024):
        assert len({int(parts[d][0]) // 1000 for d, _, _ in got}) == 1
    assert list(packing.pack_shard([], 1024)) == []


def test_places_bring_related_parts_together(spark):
    """Copies that stand far apart in the table meet in one shard, few of many."""
    rng = np.random.default_rng(2)
    texts = [" ".join(f"{rng.integers(10**9):x}" for _ in range(60)) for _ in range(60)]
    rows = [(k * 60 + i, f"{t} v{k}") for k in range(3) for i, t in enumerate(texts)]
    got = packing.pack(frame(spark, rows).repartition(7), JSON, P.PATTERN, shard=20).collect()
    sequences = defaultdict(set)
    for r in got:
        sequences[r.sequence_id].add(r.doc_id)
    met = {i % 60 for s in sequences.values() for i in s for j in s if i < j and i % 60 == j % 60}
    assert len(met) >= 50


def test_places():
    assert packing.place(np.array([5, 9, 7, 9, 0], np.uint32)) == (9 << 40 | 7 << 20 | 5)
    assert packing.place(np.array([0], np.uint32)) == 0 and packing.place(np.array([3, 0], np.uint32)) == 3 << 40


def test_packing_of_nothing(spark):
    assert packing.pack(frame(spark, []), JSON, P.PATTERN).collect() == []
