import random
import re
from collections import defaultdict

import numpy as np
from helpers import WORDS
from test_native import brute_dedup, sha
from test_similar import brute_components

import corpus_pipeline
from faunaflow.llm import secret_scan
from faunaflow.llm.common import written


def test_every_stage_against_brute_force(spark, tmp_path):
    rng, rows, labels = random.Random(5), [], []
    plain = lambda n: " ".join(rng.choice(WORDS) + rng.choice("abcd") for _ in range(n)) + "."
    for i in range(300):
        bad = i % 6 == 0
        text = " ".join(w.upper() + "%%%" for w in plain(40).split()) if bad else plain(rng.randint(20, 90))
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, 0 if bad else 1, 0))
    copy = rows[1][1]
    rows += [(400 + i, copy.replace(" ", "  "), "en", "s1", 5) for i in range(5)] + [(410, copy + " more", "en", "s1", 5)]
    rows += [(420, plain(30) + ' password = "abcdefgh1234" x', "en", "s1", 5), (430, None, None, None, None), (431, "", "en", "s1", 0), (431, "", "en", "s1", 0), (None, plain(12), "en", "s0", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, now, str(tmp_path)))
        seen[name] = (now.collect(), out.collect())
        assert name == "packing" or out.columns == corpus_pipeline.COLUMNS
        now = out

    kept = {r.doc_id for r in seen["quality"][1]}
    assert {i for i in range(300) if i % 6} <= kept and not kept & {i for i in range(0, 300, 6)}

    before, after = seen["exact_dedup"]
    want = {sha(n): i for n, (i, _) in brute_dedup([(r.doc_id, r.text) for r in before]).items()}
    assert sorted((sha(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")), r.doc_id or -1) for r in after) == sorted((h, i or -1) for h, i in want.items())

    before, after = seen["near_dedup"]
    groups = brute_components([(r.doc_id, r.text) for r in before])
    assert sorted(r.doc_id or -1 for r in after) == sorted({i or -1 for i, _, c in groups if i == c})
    assert 410 not in {r.doc_id for r in after}

    before, after = seen["secrets"]
    assert len(before) == len(after)
    for a, b in zip(sorted(before, key=lambda r: r.doc_id or -1), sorted(after, key=lambda r: r.doc_id or -1)):
        assert b.n_chars == len(b.text) and (secret_scan.MASK in b.text) == (a.doc_id == 420)
        assert (a.doc_id == 420) or (a.text or "") == b.text

    before, after = seen["packing"]
    pieces = defaultdict(dict)
    for r in after:
        pieces[r.doc_id][r.start] = np.frombuffer(bytes(r.ids), "<u4")
    assert pieces.keys() == {r.doc_id for r in before}
    assert sum(len(x) for p in pieces.values() for x in p.values()) == sum({r.doc_id: r.doc_tokens for r in after}.values())


def test_run_equals_its_stages(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"some text {i} with words.", "en", "s", 9) for i in range(20)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(range(20))
