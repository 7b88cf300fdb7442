import hashlib
import os
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import AWKWARD, WORDS, corpus, frame
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from faunaflow.llm import jaccard, substrings
from faunaflow.llm.common import settled, written
from faunaflow.llm.components import components
from faunaflow.llm.words import window_hashes

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def _shuffle_files(spark):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f for folder in folders for _, _, files in os.walk(folder.getPath()) for f in files if f.startswith("shuffle_")}


def test_a_finished_phase_leaves_no_shuffle_files(spark):
    before = _shuffle_files(spark)
    phase = written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    made = _shuffle_files(spark) - before
    settled(phase)
    until = time.time() + 10
    while made & _shuffle_files(spark) and time.time() < until:
        time.sleep(0.1)
    assert made and not made & _shuffle_files(spark)


# connected components


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 150), (150, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, **{i: 100 for i in range(100, 140)}, 150: 150, 200: 150}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


# op5


def brute_components(rows):
    """Counter of (doc_id, n_shingles, component_id)."""
    sets = []
    for _, t in rows:
        w = SPLIT.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    groups = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        groups[find(k)].append(i)
    least = {g: min((i for i in ids if i is not None), default=None) for g, ids in groups.items()}
    return Counter((i, len(sets[k]), i if not sets[k] else least[find(k)]) for k, (i, _) in enumerate(rows))


def edited(rng, words, share):
    return [rng.choice(WORDS) + "x" if rng.random() < share else w for w in words]


def near_corpus(seed=1):
    rng = random.Random(seed)
    rows = list(AWKWARD) + [(20, "Alpha  beta"), (21, "alpha BETA"), (22, "alpha beta gamma delta epsilon"), (None, "alpha beta gamma delta epsilon zeta")]
    passage = [rng.choice(WORDS) + rng.choice("pqrs") for _ in range(60)]
    i = 100
    for base in range(6):
        words = [rng.choice(WORDS) + rng.choice("abcdefgh") for _ in range(rng.choice([8, 30, 120]))]
        for _ in range(25):
            rows.append((i, " ".join(edited(rng, words, rng.choice([0, 0.01, 0.03, 0.05])))))
            i += 1
    for _ in range(40):  # one passage in otherwise different texts
        own = [rng.choice(WORDS) + rng.choice("ijklmn") for _ in range(rng.choice([10, 20, 200]))]
        rows.append((i, " ".join(own[:5] + passage + own[5:])))
        i += 1
    return rows


@pytest.mark.parametrize("settings_", [{}, {"HOT_SHARE": 1e-6, "STAR_ROUNDS": 1}, {"BROADCAST_ROWS": 0, "STAR_ROUNDS": 0}, {"STAR_ROUNDS": 0, "REMEMBERED": 3}, {"HOT_SHARE": 0.0, "HOT_TOKENS": 20}])
def test_jaccard_components_against_brute_force(spark, monkeypatch, settings_):
    for k, v in settings_.items():
        monkeypatch.setattr(jaccard, k, v)
    rows = near_corpus()
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(frame(spark, rows).repartition(3)).collect())
    assert got == brute_components(rows)


def test_classes_that_share_a_hash_stay_apart(spark, monkeypatch):
    real = jaccard._class_of
    monkeypatch.setattr(jaccard, "_told_apart", lambda df, tell=jaccard._told_apart: tell(df.withColumn("cls", F.lit(5).cast("long"))))
    rows = near_corpus()[13:60]
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(frame(spark, rows)).collect())
    assert got == brute_components(rows) and len(real(np.arange(3))) == 2


def test_jaccard_components_of_many_null_ids(spark):
    rows = [(None, f"text number {i % 7} of words that has no id at all") for i in range(300)] + [(3, "text number 1 of words that has no id at all")]
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(frame(spark, rows)).collect())
    assert got == brute_components(rows)


def test_jaccard_components_of_nothing(spark):
    assert jaccard.jaccard_components(frame(spark, [])).collect() == []


# op7


def brute_removal(rows):
    words = [SPLIT.findall(t or "") for _, t in rows]
    order = [float("inf") if i is None else i for i, _ in rows]
    first = {}
    for k in sorted(range(len(rows)), key=lambda k: order[k]):
        for s in range(len(words[k]) - 49):
            first.setdefault(tuple(words[k][s : s + 50]), order[k])
    out = Counter()
    for k, w in enumerate(words):
        gone = [False] * len(w)
        for s in range(len(w) - 49):
            if first[tuple(w[s : s + 50])] < order[k]:
                gone[s : s + 50] = [True] * 50
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[rows[k][0], len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("share", [0.005, 1e-6])
def test_substring_removal_against_brute_force(spark, monkeypatch, share):
    monkeypatch.setattr(substrings, "HOT_SHARE", share)
    rng = random.Random(2)
    fresh = lambda n: [rng.choice(WORDS) + str(rng.randrange(10**6)) for _ in range(n)]
    passages = [fresh(n) for n in (49, 50, 51, 80, 200)]
    rows = list(AWKWARD)
    for i in range(60):
        words = fresh(rng.randrange(80))
        for p in rng.sample(passages, rng.randrange(3)):
            a = rng.randrange(0, max(1, len(p) - 49))
            words += p[a : a + rng.randrange(45, 210)] + fresh(rng.randrange(3))
        rows.append((rng.choice([i + 100, i + 100, None, 130]), "\n ".join(words)))
    got = substrings.remove_repeats(frame(spark, rows).repartition(3)).collect()
    got = Counter((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in got)
    assert got == brute_removal(rows)


def test_removal_from_rows_without_ids(spark):
    """They do not remove each other's words, but lose those that a row with an id has."""
    rng = random.Random(6)
    fresh = lambda n: " ".join(rng.choice(WORDS) + str(rng.randrange(10**6)) for _ in range(n))
    one, two = fresh(70), fresh(80)
    rows = [(None, one), (None, two), (None, f"{one} x {two}"), (None, one), ((1 << 63) - 1, one), (4, two), (-(1 << 63), fresh(60))]
    got = substrings.remove_repeats(frame(spark, rows).repartition(3)).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed) for r in got) == Counter({(None, 70, 0): 2, (None, 80, 80): 1, (None, 151, 80): 1, ((1 << 63) - 1, 70, 0): 1, (4, 80, 0): 1, (-(1 << 63), 60, 0): 1})


def test_removal_of_nothing(spark):
    assert substrings.remove_repeats(frame(spark, [])).collect() == []


def test_every_shift_meets_the_cover():
    for shift in range(substrings.PERIOD):
        assert any((c + shift) % substrings.PERIOD in substrings.COVER for c in substrings.COVER)


@settings(max_examples=50, deadline=None)
@given(st.integers(50, 200), st.integers(0, 100))
def test_equal_windows_share_an_anchor(n, shift):
    places = set(substrings.anchor_places(n + shift))
    for i in range(n - 49):
        assert any(i + k in places and i + shift + k in places for k in range(substrings.PERIOD))


def test_window_hashes_do_not_depend_on_position():
    h = np.random.default_rng(0).integers(0, 1 << 63, 100).astype(np.uint64)
    assert window_hashes(np.r_[h, h], 7)[:94].tolist() == window_hashes(np.r_[h, h], 7)[100:194].tolist() == window_hashes(h, 7).tolist()
