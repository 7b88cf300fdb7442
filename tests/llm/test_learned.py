import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import WORDS, frame

from faunaflow.llm import quality as q
from faunaflow.llm import toxicity
from faunaflow.llm.learning import Logistic, bounded, training_labels
from faunaflow.llm.quality import quality

RUDE = ["grunkel", "blarfish", "snotwit"]
HIDDEN = {"grunkel": "gr9nk3l", "blarfish": "b.l.a.r.f.i.s.h", "snotwit": "s n o t w i t"}


def held(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, text string")


@pytest.fixture(scope="module")
def talk():
    rng, rows = random.Random(0), []
    for i in range(600):
        words = [rng.choice(WORDS) + rng.choice(["", "s", "ing"]) for _ in range(rng.randint(10, 80))]
        toxic = i % 5 == 0
        for w in rng.sample(RUDE, 2) if toxic else []:
            words.insert(rng.randrange(len(words)), w if rng.random() < 0.6 else {"blarfish": HIDDEN["blarfish"]}.get(w, w.replace("n", "nnnn")))
        rows.append((i, " ".join(words), toxic))
    return rows


def test_toxicity_learns_and_restores(spark, talk):
    docs = frame(spark, [(i, t) for i, t, _ in talk] + [(9000, None), (9001, ""), (9001, ""), (None, "x"), (9002, "a " * 3000)])
    # wrong labels on held-out rows must not matter
    labels = labelled(spark, [(i, 1, int(t) if not held(i) else 1 - int(t), "z") for i, _, t in talk] + [(None, 1, 1, "z"), (9000, 1, None, "z")])
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(talk) + 5 and all(0 <= r.score <= 1 for r in got)
    score = {r.doc_id: r for r in got}
    assert all(r.predicted == int(r.score >= 0.7) and r.held_out == (r.doc_id is not None and held(r.doc_id)) for r in got)
    wrong = sum(score[i].predicted != t for i, _, t in talk if held(i))
    assert wrong <= 0.03 * sum(held(i) for i, _, _ in talk)


def test_toxicity_without_labels(spark):
    docs = frame(spark, [(1, "a b"), (2, None)])
    assert [r.predicted for r in toxicity.toxicity(docs, labelled(spark, [])).collect()] == [0, 0]
    assert toxicity.toxicity(frame(spark, []), labelled(spark, [])).collect() == []


@pytest.fixture(scope="module")
def restorer():
    return toxicity.Restorer(toxicity.trigrams([" ".join((RUDE + ["assmule"]) * 5 + WORDS * 3).encode()] * 50))


@pytest.mark.parametrize("hidden", [
    "snotwit: s n o t w i t", "snotwit: s.n.0.t.w.1.t", "snotwit: s n 0 t w 1 t", "snotwit: sn.ot.wit", "snotwit: snootwit", "snotwit: snotw11t", "snotwit: $n0tw1t!!", "snotwit: snotwiiiit",
    "snotwit: s-n-o-o-o-t-w-i-t", "blarfish: b.l.a.r.f.i.s.h", "blarfish: b.l.a.r.f.1.s.h", "blarfish: bl@@rfish", "blarfish: \"blarf1sh\"", "blarfish: bl4rfi$$h",
    "grunkel: gr*nkel", "grunkel: gr*nk3l", "grunkel: grun-kel", "grunkel: g_r_u_n_k_e_1", "assmule: @$$mule", "assmule: 455mule", "assmule: 4$$mu1e", "assmule: a.s.s.m.u.l.e",
])
def test_mixed_disguises_are_restored(restorer, hidden):
    word, disguise = hidden.split(": ")
    assert word in toxicity.Reader(restorer).words(f"the {disguise} was")


def test_plain_words_stay(restorer):
    reader = toxicity.Reader(restorer)
    assert reader.words("The 123 plain, words?") == ["the", "123", "plain", "words"]
    for text in ["(was)", "with,", '"that"', "this!", "$100", "2024-01-02"]:
        assert reader.words(text) == [text.strip('(),"!')]
    assert reader.words("and/or the,that this.is") == ["and", "or", "the", "that", "this", "is"]
    assert len(reader.words("a1" * 100_000)) >= 1 and reader.words("é" * 3) and reader.words("") == []


def plain_toxicity(restorer, docs, labels):
    """Cues, evidence and probabilities, from counts over lists."""
    reader = toxicity.Reader(restorer)
    seen, rows = set(), []
    for i, t in sorted(docs):
        key = (labels.get(i), " ".join(t.lower().split()))
        if i in labels and not held(i) and key not in seen:
            seen.add(key)
            rows.append((t, labels[i]))
    count = [Counter(f for t, y in rows if y == label for f in {f for w in reader.words(t) for f in toxicity.features(w)}) for label in (0, 1)]
    p, q = sum(y for _, y in rows), sum(1 - y for _, y in rows)
    odds = {f: math.log((n + 0.5) / (p + 1)) - math.log((count[0][f] + 0.5) / (q + 1)) for f, n in count[1].items() if n >= max(5, 0.01 * p)}
    odds = {f: v for f, v in odds.items() if v >= 2}

    def evidence(t):
        tokens = reader._tokens(t)
        best = sorted((max((odds.get(f, 0.0) for w in reader._restored(k) for f in toxicity.features(w)), default=0.0) for k in tokens), reverse=True)
        best = [b for b in best if b]
        return [*(best + [0.0, 0.0])[:2], math.log1p(sum(best)), math.log1p(len(best)), math.log1p(len(tokens))]

    model = Logistic(np.array([evidence(t) for t, _ in rows]), np.array([float(y) for _, y in rows]))
    return {i: 1 / (1 + math.exp(-model.logit(np.array([evidence(t)]))[0])) for i, t in docs}


def test_scores_against_plain_python(spark, talk):
    docs = [(i, t) for i, t, _ in talk] + [(9001, ""), (9002, "grunkel " * 30), (9003, talk[5][1].upper())]
    labels = {i: int(t) for i, _, t in talk} | {9003: 1}
    want = plain_toxicity(toxicity.Restorer(toxicity.trigrams(t.encode() for _, t in docs)), docs, labels)
    got = toxicity.toxicity(frame(spark, docs), labelled(spark, [(i, 1, y, "") for i, y in labels.items()])).collect()
    assert len(got) == len(want) and all(abs(r.score - want[r.doc_id]) < 1e-6 for r in got)


def test_toxicity_of_repeated_ids_and_clashing_columns(spark, talk):
    rows = [(i, t, 1.0, True, 3, ["x"], "y") for i, t, _ in talk] + [(0, "other text of the same id", 0.0, False, 1, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, held_out boolean, predicted int, x array<string>, label string")
    got = toxicity.toxicity(docs, labelled(spark, [(i, 1, int(t), "z") for i, _, t in talk])).collect()
    assert len(got) == len(rows) and {r.doc_id for r in got} == {i for i, _, _ in talk}


def test_viterbi_is_the_best_path():
    """Against all paths of the lattice."""
    import itertools

    restorer = toxicity.Restorer(toxicity.trigrams([b"silly little bottle still tells lies " * 9]))
    for word in ["s1lly", "b0tt1e", "t3115", "s.i.l.l.y", "liiiies"]:
        best = None
        for path in itertools.product(*restorer.lattice(word), [(" ", 0.0)]):
            x = y = 0
            total = 0.0
            for text, price in path:
                total += price
                for c in text:
                    s = toxicity.symbol(c)
                    total += restorer.cost[x][y][s]
                    x, y = y, s
            found = (total, "".join(t for t, _ in path).strip())
            best = found if best is None else min(best, found)
        assert restorer.restore(word) == best[1]


def junk(rng, n):
    return " ".join(rng.choice(WORDS).upper() + "!!" for _ in range(n))


def test_quality_uses_text_and_site(spark):
    rng, rows, labels = random.Random(3), [], []
    for i in range(600):
        bad = i % 4 == 0
        rows.append((i, junk(rng, 30) if bad else " ".join(rng.choice(WORDS) for _ in range(30)) + ".", "h1" if i % 2 else "h2", "p", 7))
        labels.append((i, 0 if bad else 1, 0, "t"))
    rows += [(1000, None, None, None, 7), (1001, "", "new", "p", 7), (1001, "", "new", "p", 7), (None, "fine words here.", "h1", "p", 7), (1002, "word " * 4000, "h2", "q", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, q_keep int")
    got = quality(docs, labelled(spark, labels)).collect()
    assert len(got) == len(rows) and set(docs.columns) <= set(got[0].asDict())
    by = {r.doc_id: r for r in got}
    assert all(by[i].q_keep == (i % 4 != 0) for i in range(600))
    assert by[1001].q_host_rate == by[1001].q_path_rate and by[1].q_host_rate > by[2].q_host_rate
    assert quality(docs.limit(0), labelled(spark, labels)).collect() == []
    assert all(r.q_keep for r in quality(docs, labelled(spark, [])).collect())


def plain_strength(rates, free):
    """Prior strength from (n, y, target) of each site, by moments."""
    total, squares = sum(n for n, _, _ in rates), sum(n * n for n, _, _ in rates)
    variance = sum(n * t * (1 - t) for n, _, t in rates) / total
    spread = sum(n * (y / n - t) ** 2 for n, y, t in rates)
    rho = (spread / variance - free) / (total - squares / total - free)
    return 1 / min(max(rho, 1e-4), 0.9) - 1


def test_quality_against_plain_python(spark):
    rng, rows, label = random.Random(8), [], {}
    for i in range(500):
        bad, host = rng.random() < 0.3, f"h{rng.randrange(6)}"
        words = [rng.choice(WORDS).upper() + "!" if bad and rng.random() < 0.8 else rng.choice(WORDS) + rng.choice("abc") for _ in range(rng.randint(0, 40))]
        rows.append((i, " ".join(words), host, rng.choice(["p", "q"])))
        label[i] = int(bad == (host == "h1") and rng.random() < 0.95)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = {r.doc_id: r for r in quality(docs, labelled(spark, [(i, y, 0, "") for i, y in label.items()])).collect()}

    train = [r for r in rows if not held(r[0])]
    path, host = Counter(), Counter()
    for i, _, h, p in train:
        path[h, p] += 1 + label[i] * 1j
        host[h] += 1 + label[i] * 1j
    rate = (sum(label[r[0]] for r in train) + 0.5) / (len(train) + 1)
    a = plain_strength([(n.real, n.imag, rate) for n in host.values()], len(host) - 1)
    host_rate = {h: (n.imag + a * rate) / (n.real + a) for h, n in host.items()}
    b = plain_strength([(n.real, n.imag, host_rate[h]) for (h, _), n in path.items()], len(path) - len(host))
    path_rate = {(h, p): (n.imag + b * host_rate[h]) / (n.real + b) for (h, p), n in path.items()}

    # halves as Spark deals them out
    half = {r.doc_id: r.h for r in docs.selectExpr("doc_id", "pmod(xxhash64(doc_id), 2) as h").collect()}
    places = {i: set(next(q.word_places([t.encode()])).tolist()) for i, t, _, _ in rows}

    def odds(ids):
        n = Counter((label[i], w) for i in ids for w in places[i])
        total = Counter(label[i] for i in ids)
        return lambda w: math.log((n[1, w] + 0.5) / (total[1] + 1)) - math.log((n[0, w] + 0.5) / (total[0] + 1))

    mean = lambda i, o: sum(map(o, places[i])) / len(places[i]) if places[i] else 0.0
    ids = [r[0] for r in train]
    other = [odds([i for i in ids if half[i] != k]) for k in (0, 1)]
    x = np.array([[*q.measures(t.encode()), mean(i, other[half[i]])] for i, t, _, _ in train])
    model, everything = Logistic(x, np.array([float(label[i]) for i in ids])), odds(ids)
    for i, t, h, p in rows:
        logit = model.logit(np.array([[*q.measures(t.encode()), mean(i, everything)]]))[0]
        logit += math.log(path_rate[h, p] / (1 - path_rate[h, p])) - math.log(rate / (1 - rate))
        assert abs(got[i].q_path_rate - path_rate[h, p]) < 1e-9 and abs(got[i].q_host_rate - host_rate[h]) < 1e-9
        assert abs(got[i].q_score - 1 / (1 + math.exp(-logit))) < 1e-6 and got[i].q_keep == (got[i].q_score >= 0.5)


def test_quality_keeps_columns_of_any_name(spark):
    names = ["label", "labelled", "path_rate", "host_rate", "q_text", "q_mine", "q_label", "q_labelled", "n", "q_row", "q_score"]
    docs = spark.createDataFrame([(i, "some text", "h", "p", *[k * 100 + i for k in range(len(names))]) for i in range(9)], "doc_id long, text string, source string, lang string, " + ", ".join(f"{n} long" for n in names))
    got = quality(docs, labelled(spark, [(i, i % 2, 0, "") for i in range(9)])).collect()
    for r in got:
        assert [r[n] for n in names[:-1]] == [k * 100 + r.doc_id for k in range(len(names) - 1)] and 0 < r.q_score < 1


def test_sparse_sites_shrink_to_the_global_rate(spark):
    text = "the same words for all."
    rows = [(i, text, f"host{i % 40}", "p") for i in range(4000)] + [(5000 + i, text, "tiny", "p") for i in range(2)]
    labels = [(i, int((i % 40) < 20 or (i // 40) % 5 == 0), 0, "") for i in range(4000)] + [(5000 + i, 0, 0, "") for i in range(2)]
    got = {r.source: r for r in quality(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"), labelled(spark, labels)).collect()}
    assert got["host3"].q_host_rate > 0.9 and got["host30"].q_host_rate < 0.35
    assert 0.1 < got["tiny"].q_host_rate < 0.6


def test_labels_and_regression(spark):
    rows = [(i, 1, i % 2, "") for i in range(3000)] + [(6, 1, 1, ""), (6, 1, 1, ""), (8, None, None, "")]
    train = training_labels(labelled(spark, rows), "doc_id", "toxic")
    got = {r.doc_id: r.label for r in train.collect()}
    assert not any(held(i) for i in got) and (held(6) or got[6] == 1)
    assert 300 < bounded(train, 500).count() < 700
    x = np.random.default_rng(0).normal(size=(2000, 2))
    y = (x[:, 0] + np.random.default_rng(1).logistic(size=2000) > 0).astype(float)
    model = Logistic(x, y)
    assert abs(model.w[1] / model.scale[0] - 1) < 0.2 and abs(model.w[2]) < 0.2
    assert Logistic(x[:0], y[:0]).logit(np.zeros((1, 2))) == 0
