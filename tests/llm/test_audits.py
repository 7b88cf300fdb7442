import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import pytest
import xxhash
from helpers import AWKWARD, corpus, frame

from faunaflow.llm import divergence, simhash
from faunaflow.llm.divergence import source_divergence
from faunaflow.llm.filter_audit import METRICS, filter_audit, part_cells, prefixes
from faunaflow.llm.simhash import fingerprint, longer_masks, near_edges, simhash_components

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# op11


def plain_fingerprint(text):
    words = SPLIT.findall(lowered(text))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked_components(fps, distance=2):
    """The least place that each place reaches, by comparing all pairs."""
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= distance:
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return [find(a) for a in range(len(fps))]


def simhash_rows():
    rng = random.Random(3)
    rows = list(AWKWARD) + [(None, "Only"), (30, "only"), (31, "only two"), (32, " ONLY\x0btwo "), (33, "x " * 70_000)]
    for i in range(8):
        words = corpus(1, seed=i, words=300)[0][1].split() * 3
        for k in range(25):
            mine = [w + "q" if rng.random() < rng.choice([0, 0.002, 0.01]) else w for w in words]
            rows.append((100 + 25 * i + k, " ".join(mine)))
    return rows


@pytest.mark.parametrize("limit", [256, 2])
def test_simhash_against_brute_force(spark, limit):
    rows = simhash_rows()
    fps = [plain_fingerprint(t) for _, t in rows]
    root = linked_components(fps)
    ids = defaultdict(list)
    for (i, _), r in zip(rows, root):
        ids[r].append(i)
    least = {r: min((i for i in x if i is not None), default=None) for r, x in ids.items()}
    got = Counter(map(tuple, simhash_components(frame(spark, rows), limit=limit).collect()))
    assert got == Counter((i, f"{fp:016x}", least[r]) for (i, _), fp, r in zip(rows, fps, root))


def test_fingerprints_do_not_depend_on_chunks(monkeypatch):
    text = corpus(1, seed=9, words=900)[0][1].encode()
    whole = fingerprint(text)
    monkeypatch.setattr(simhash, "CHUNK", 7)
    assert whole == fingerprint(text) == plain_fingerprint(text.decode())


@pytest.mark.parametrize("limit", [256, 8, 1])
def test_crowded_keys_lose_no_link(spark, limit):
    """A ball of fingerprints about one centre crowds every key; chains hang on it, and others are near but not linked."""
    rng, centre = random.Random(5), random.Random(6).getrandbits(64)
    fps = {0, 1 << 63, 7, (1 << 64) - 1}
    for _ in range(400):
        x = centre
        for b in rng.sample(range(64), rng.choice([1, 2, 3, 4, 5])):
            x ^= 1 << b
        fps.add(x)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    edges = near_edges(spark.createDataFrame([(x,) for x in signed], "fp long"), limit=limit).collect()
    parent = {x: x for x in signed}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(a)] = find(b)
    groups = lambda roots: {frozenset(x for x, r in zip(signed, roots) if r == one) for one in set(roots)}
    assert groups([find(x) for x in signed]) == groups(linked_components(fps))
    assert limit == 1 or len(edges) < 10 * 100 * len(fps)


def test_every_close_pair_shares_a_mask():
    rng = random.Random(1)
    masks = [0]
    for depth in range(3):
        masks = sorted({x & (1 << 64) - 1 for m in masks for x in longer_masks(m)})
        assert max(64 - m.bit_count() for m in masks) <= (26, 11, 5)[depth]
        for _ in range(300):
            flips = sum(1 << b for b in rng.sample(range(64), 2))
            assert any(not m & flips for m in masks)
    assert all(longer_masks(m) == [m - (1 << 64) if m >> 63 else m] for m in masks)


def test_simhash_of_nothing(spark):
    assert simhash_components(frame(spark, [])).collect() == []
    assert simhash_components(frame(spark, [(None, None)])).collect() == [(None, "0" * 16, None)]


# op12

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain_divergence(rows, min_docs=10, ranks=10):
    """rows: (lang, source, text). Counter of result rows."""
    counts, docs, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        terms = TERM.findall(lowered(text))
        sources[lang].add(source)
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    f = lambda p, q: (p - q) ** 2 // (p + q)
    for lang, own in sources.items():
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        v = len(kept)

        def scaled(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + (10**9 * (count[t] + 2)) // (total + 2 * v) for t in kept}

        p = {s: scaled(counts[lang, s]) for s in own}
        q = scaled(sum((counts[lang, s] for s in own), Counter()))
        for s in own:
            pair = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in own - {s}]
            term = [(f(p[s][t], q[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, top in (("pair", pair, None), ("term", term, ranks)):
                for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:top], 1):
                    out.append((lang, s, part, item, value, rank))
    return Counter(out)


def divergence_rows():
    rng = random.Random(4)
    rows = [(None, None, None), ("", "", ""), (None, "z", "lone"), ("fr", "only", "été ÉTÉ été-Été"), ("xx", "a", "1 2 3"), ("xx", None, "")]
    for k in range(300):
        lang, source = rng.choice(["en", "en", "de", None]), rng.choice(["s1", "s1", "s2", "s3", None, "ß", "zz"])
        text = " ".join(rng.choice(["Alpha", "beta", "gamma3delta", "don't", "naïve", "😀x", "Über", "über", "q" * 300, f"w{rng.randint(0, 9)}x{rng.choice('abcdefghijk')}", source or "none"]) for _ in range(rng.choice([0, 3, 30])))
        rows.append((lang, source, text))
    return rows + rows[50:90] + [("en", "long", "Alpha beta, " * 60_000)]


@pytest.mark.parametrize("settings", [{}, {"digest_bits": 3}, {"digest_bits": 1}, {"min_docs": 1, "ranks": 2}, {"min_docs": 10_000}])
def test_divergence_against_brute_force(spark, monkeypatch, settings):
    if "digest_bits" in settings:
        monkeypatch.setattr(divergence, "ENTRIES", 20)
        monkeypatch.setattr(divergence, "PAIRS", 3)
    rows = divergence_rows()
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "lang string, source string, text string, n long, term string, digest int").repartition(3)
    got = Counter(map(tuple, source_divergence(df, **settings).collect()))
    assert got == plain_divergence(rows, **{k: v for k, v in settings.items() if k != "digest_bits"})


def test_divergence_of_nothing(spark):
    assert source_divergence(spark.createDataFrame([], "lang string, source string, text string")).collect() == []


# op13


def plain_audit(rows, labels):
    """rows: (doc_id, source, text); labels: (doc_id, quality, toxic)."""
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for i, _, t in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    parts = defaultdict(list)
    for i, part, text in rows:
        t = text or ""
        words = SPLIT.findall(t)
        fails = {
            "A": len(words) < 50,
            "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t),
            "D": any(c in "#$%&*|" for c in t),
            "E": i is not None and least[t] < i,
        }
        parts[part or ""].append(({x for x in fails if fails[x]}, i in good, i in toxic))
    out = {}
    for part, docs in parts.items():
        for order in permutations("ABCDE"):
            for k, x in enumerate(order):
                before = set(order[:k])
                gone = [d for d in docs if x in d[0] and not d[0] & before]
                kept = sum(not d[0] & (before | {x}) for d in docs)
                row = (kept, len(gone), sum(x in d[0] and bool(d[0] & before) for d in docs), sum(d[0] == {x} for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone))
                out[part, "".join(order), k + 1] = row
    shapley = Counter()
    for (part, order, k), row in out.items():
        shapley[part, order[k - 1]] += row[1]
    return Counter((*key, *row, shapley[key[0], key[1][key[2] - 1]]) for key, row in out.items())


def test_audit_against_brute_force(spark):
    rng = random.Random(8)
    texts = [t for _, t in AWKWARD] + ["A b C d", "x # y", "100 %", "one two " * 30, "Ä" * 30 + "A", "X" * 5 + "y" * 95, "X" * 6 + "y" * 94] + [t for _, t in corpus(30, seed=2, words=120)]
    rows = [(rng.choice([None, *range(60)]), rng.choice(["a", "a", "b", None, "", "c"]), rng.choice(texts)) for _ in range(400)]
    rows += [(70, "only", "x"), (70, "only", "x"), (71, "big", "word # " * 100_000)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 80, 2)] + [(2, 1, 1), (None, 1, 1)]
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], "doc_id long, source string, text string, mask int, part string, digest string")
    got = filter_audit(df, spark.createDataFrame([(*r, 0) for r in labels], "doc_id long, quality int, toxic int, mask int"))
    assert got.columns == ["part", "filter_order", "step", *METRICS, "shapley"]
    assert Counter(map(tuple, got.collect())) == plain_audit(rows, labels)


def test_audit_of_nothing(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit(spark.createDataFrame([], "doc_id long, source string, text string"), labels).collect() == []
    got = filter_audit(spark.createDataFrame([(None, None, None)], "doc_id long, source string, text string"), labels).collect()
    assert len(got) == 600 and {(r.part, r.good_lost) for r in got} == {("", 0)}


def test_many_parts_pass_the_bound_of_a_recursion(spark):
    """4,000 parts have 1.3 million prefixes, more than Spark's own bound on a recursion."""
    rows = spark.range(4000).selectExpr("id AS doc_id", "cast(id as string) AS part", "cast(id % 32 as int) AS mask")
    cells = part_cells(rows, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert prefixes(cells, "ABCDE").count() == 4000 * 325
