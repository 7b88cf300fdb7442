"""Toxicity by noisy-channel deobfuscation.

A disguised word (digits or signs for letters, letters masked or set apart, letters repeated, in any
mixture) is a lattice: every place offers letters, itself, or nothing, at a cost of the channel. Viterbi
search picks the path whose letters are likeliest under a character trigram model, counted over all
documents, less the channel's costs. The restored words are scored: words and word beginnings that
labelled toxic texts have and others lack carry evidence, and a logistic regression turns a document's
evidence into a probability.

A word of letters without a doubled one has a lattice of one path, itself; every other word with a letter is searched,
each distinct one once in a task.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from faunaflow.llm.common import SPACE, documents, written
from faunaflow.llm.learning import Logistic, bounded, held_out, training_labels

#: Labelled rows to learn from, at most.
MAX_LABELLED = 40_000
THRESHOLD = 0.7
#: A cue stands in this share of the toxic texts, and in 5 of them, at least; its log odds are this much.
#: So there are at most 1 / CUE_SHARE times the features of a mean text, or a fifth of a small sample's.
CUE_SHARE, CUE_TEXTS, CUE_ODDS = 0.01, 5, 2.0
BEGINNINGS = (4, 5, 6)
#: Distinct words that a task remembers before it starts anew; longer words are not remembered.
REMEMBERED, REMEMBERED_CHARS = 500_000, 64

#: Letters that a digit or sign may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e",
}
#: Signs that may hide any letter.
MASKS = "*#%"
LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Costs of the channel, in nats: a digit or sign for a letter, itself, or nothing; a mask for a letter;
#: a separator that joins, or parts; a run of letters that is one, or two of them; a pair that is one.
AS_LETTER, AS_ITSELF, LEFT_OUT, MASKED, JOINED, PARTED, SPACED, ONCE, TWICE, PAIR_ONCE = 1.0, 3.0, 6.0, 3.3, 1.0, 1.5, 0.0, 0.5, 0.5, 3.0

# Symbols of the model: 0 between words, 1 to 26 letters, 27 any other letter.
SYMBOLS, OTHER = 28, 27
_TABLE = np.zeros(256, dtype=np.int64)
_TABLE[97:123] = _TABLE[65:91] = np.arange(1, 27)
_TABLE[192:] = OTHER
_LATER_BYTES = bytes(range(128, 192))
_SYMBOLS = _TABLE.astype(np.uint8).tobytes()


def symbol(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else OTHER if c.isalpha() else 0


def trigrams(texts) -> np.ndarray:
    """Counts of symbol trigrams, runs of 0 as one."""
    total = np.zeros(SYMBOLS**3, dtype=np.int64)
    for text in texts:
        s = _TABLE[np.frombuffer(b"\n\n" + text.translate(None, _LATER_BYTES) + b"\n", dtype=np.uint8)]
        s = s[np.r_[True, True, (s[2:] > 0) | (s[1:-1] > 0)]]
        total += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS**3)
    return total


class Restorer:
    """Finds words that may be disguised and restores them under a trigram model."""

    pair = re.compile(r"(.)\1", re.DOTALL)
    #: Letters of which none is doubled, as one part; or one character and its repeats.
    parts = re.compile(r"(?:([a-z])(?!\1))+|(.)\2*", re.DOTALL)
    leading, trailing = frozenset("@$!|€+"), frozenset("@$€")

    def __init__(self, counts: np.ndarray):
        c = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(float)
        pairs, ones = c.sum(0), c.sum((0, 1))
        # each order is smoothed by the one below
        p1 = (ones + 1) / (ones.sum() + SYMBOLS)
        p2 = (pairs + 5 * p1) / (pairs.sum(1, keepdims=True) + 5)
        self.cost = (-np.log((c + 5 * p2[None]) / (c.sum(2, keepdims=True) + 5))).tolist()
        #: The same in one list; the state of two symbols (x, y) is x * SYMBOLS + y.
        self.flat = [v for two in self.cost for one in two for v in one]
        self.places: dict[tuple[str, int, bool], list] = {}

    def bare(self, word: str) -> str:
        """The word without the signs around it, but for those that may stand for first or last letters."""
        start, end = 0, len(word)
        if word and word[0].isalnum() and word[-1].isalnum():
            return word
        while end and not (word[end - 1].isalnum() or word[end - 1] in self.trailing):
            end -= 1
        while start < end and not (word[start].isalnum() or word[start] in self.leading):
            start += 1
        return word[start:end]

    def disguised(self, word: str) -> bool:
        """Whether the lattice has more than one path, and a letter."""
        return self.pair.search(word) is not None if word.isalpha() else any(map(str.isalpha, word))

    @staticmethod
    def options(c: str, run: int, edge: bool) -> list[tuple[str, float]]:
        """What a character and its repeats may stand for, with costs."""
        if c.isalpha():
            return [(c, 0.0)] if run == 1 else [(c + c, 0.0), (c, PAIR_ONCE)] if run == 2 else [(c, ONCE), (c + c, TWICE)]
        if c in LEET:
            nothing = AS_LETTER if edge and not c.isdigit() else LEFT_OUT
            doubled = [(x + y, AS_LETTER) for x in LEET[c] for y in LEET[c]] if run > 1 else []
            return [*((x, AS_LETTER) for x in LEET[c]), *doubled, (c * run, AS_ITSELF), ("", nothing)]
        masked = [(x, MASKED) for x in LETTERS] if c in MASKS and not edge else []
        return [("", JOINED), (" ", SPACED if c == " " else PARTED), *masked]

    def lattice(self, word: str) -> list[list[tuple[str, float]]]:
        """For each place the strings it may stand for, with costs."""
        return [[(text, price) for text, price, _ in place] for place in self._coded(word)]

    def _coded(self, word: str) -> list[list[tuple[str, float, bytes]]]:
        """The lattice with each string's symbols, runs of 0 as one."""
        out = []
        for m in self.parts.finditer(word):
            if m[2] is None:
                out.append([(m[0], 0.0, m[0].encode().translate(_SYMBOLS))])
                continue
            key = (m[2], m.end() - m.start(), m.start() == 0 or m.end() == len(word))
            place = self.places.get(key)
            if place is None:
                place = [(t, price, bytes(map(symbol, t)) if t.isalpha() else b"\0"[: len(t)]) for t, price in self.options(*key)]
                if key[1] < 4 and len(self.places) < REMEMBERED:
                    self.places[key] = place
            out.append(place)
        return out

    def restore(self, word: str) -> str:
        """The likeliest reading; one word or more."""
        cost, states = self.flat, {0: (0.0, None)}
        for options in [*self._coded(word), [(" ", 0.0, b"\0")]]:
            after: dict[int, tuple] = {}
            for at, (total, path) in states.items():
                for text, price, symbols in options:
                    to, t = at, total + price
                    for s in symbols:
                        if s or to % SYMBOLS:  # runs of 0 are one, as they are counted
                            to = to * SYMBOLS + s
                            t += cost[to]
                            to %= SYMBOLS * SYMBOLS
                    if to not in after or t < after[to][0]:
                        after[to] = (t, (path, text))
            states = after
        node, out = min(states.values(), key=lambda v: v[0])[1], []
        while node:
            node, text = node
            out.append(text)
        return "".join(reversed(out)).strip()


def features(word: str) -> list[str]:
    return [f"={word}", *(f"{word[:k]}-" for k in BEGINNINGS if len(word) > k)]


class Reader:
    """A document's restored words, or the evidence of its words."""

    def __init__(self, restorer: Restorer, cues: dict[str, float] | None = None):
        self.restorer = restorer
        self.whole = {f[1:]: v for f, v in (cues or {}).items() if f[0] == "="}
        self.begun = {f[:-1]: v for f, v in (cues or {}).items() if f[0] != "="}
        self.read: dict[str, tuple[str, ...]] = {}
        self.known: dict[str, float] = {}

    def _restored(self, word: str) -> tuple[str, ...]:
        bare, restorer = self.restorer.bare(word), self.restorer
        if not bare or not restorer.disguised(bare):
            return (bare,)
        words = restorer.restore(bare).split()
        # letters that were both repeated and set apart now stand together
        return tuple(restorer.restore(w) if w != bare and restorer.pair.search(w) else w for w in words)

    def _tokens(self, text: str) -> list[str]:
        """Words; three or more single characters in a row, as well, as one word set apart by spaces."""
        words = text.lower().split()
        single = bytes(map((1).__eq__, map(len, words)))
        at = single.find(b"\1\1\1")
        while at >= 0:
            end = single.find(b"\0", at)
            end = len(words) if end < 0 else end
            words.append(" ".join(words[at:end]))
            at = single.find(b"\1\1\1", end)
        return words

    def words(self, text: str) -> list[str]:
        tokens = self._tokens(text)
        if len(self.read) > REMEMBERED // 4:
            self.read.clear()
        fresh = {t: self._restored(t) for t in set(tokens) if t not in self.read}
        self.read.update((t, w) for t, w in fresh.items() if len(t) <= REMEMBERED_CHARS)
        return [w for t in tokens for w in (fresh.get(t) or self.read.get(t, ()))]

    def _strength(self, token: str) -> float:
        """The largest cue of a token, 0 where it has none."""
        best = 0.0
        for w in self._restored(token):
            best = max(best, self.whole.get(w, 0.0))
            for k in BEGINNINGS:
                if len(w) <= k:
                    break
                best = max(best, self.begun.get(w[:k], 0.0))
        return best

    def evidence(self, text: str) -> list[float]:
        """The two largest cues, their sum and number, and the length of a text."""
        tokens, known = self._tokens(text), self.known
        if len(known) > REMEMBERED:
            known.clear()
        fresh = {t: self._strength(t) for t in set(tokens).difference(known)}
        known.update((t, e) for t, e in fresh.items() if len(t) <= REMEMBERED_CHARS)
        found = list(filter(None, map(known.get, tokens)))
        rare = {t: e for t, e in fresh.items() if e and len(t) > REMEMBERED_CHARS}
        if rare:
            found += [rare[t] for t in tokens if t in rare]
        found.sort(reverse=True)
        first, second = (found + [0.0, 0.0])[:2]
        return [first, second, math.log1p(sum(found)), math.log1p(len(found)), math.log1p(len(tokens))]


def character_model(docs: DataFrame) -> np.ndarray:
    """Trigram counts over all documents: each task sends its sums, and 28^3 totals come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, dtype=np.int64)
        for batch in batches:
            total += trigrams(t.as_py() for t in batch.column(0))
        code = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(total[code])], ["code", "n"])

    rows = docs.select(F.col("text").cast("binary")).mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(SYMBOLS**3, dtype=np.int64)
    counts[rows["code"].to_numpy(dtype=np.int64)] = rows["n"]
    return counts


def _distinct(sample: DataFrame) -> DataFrame:
    """One of the labelled texts that are equal but for case and white space, so that copies of one text count once."""
    plain = F.regexp_replace(F.lower("text"), SPACE, " ")
    return sample.withColumn("plain", F.sha2(plain.cast("binary"), 256)).groupBy("label", "plain").agg(F.min_by("text", "doc_id").alias("text"))


def _cues(texts: DataFrame, reader, totals: dict[int, int]) -> dict[str, float]:
    """Log odds of the features that toxic texts have and others lack."""

    def counted(wanted):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            read, n = reader(), Counter()
            for batch in batches:
                for text in batch.column(0):
                    found = {f for w in set(read.words(text.as_py())) for f in features(w)}
                    n.update(found if wanted is None else found & wanted.value)
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["f", "n"])

        return run

    count = lambda label, wanted: texts.where(F.col("label") == label).select("text").mapInArrow(counted(wanted), "f string, n long").groupBy("f").agg(F.sum("n").alias("n"))
    toxic = count(1, None).where(F.col("n") >= max(CUE_TEXTS, CUE_SHARE * totals.get(1, 0))).toPandas()
    toxic = dict(zip(toxic["f"], toxic["n"]))
    rest = count(0, texts.sparkSession.sparkContext.broadcast(set(toxic))).toPandas()
    rest = dict(zip(rest["f"], rest["n"]))
    p, q = totals.get(1, 0) + 1, totals.get(0, 0) + 1
    odds = {f: math.log((n + 0.5) / p) - math.log((rest.get(f, 0) + 0.5) / q) for f, n in toxic.items()}
    return {f: v for f, v in odds.items() if v >= CUE_ODDS}


def toxicity(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """doc_id, held_out, score, predicted, n_cues: one row for each row of df.

    score is the probability of label 1, predicted 1 where it is at least 0.7. Null texts are empty. Rows
    whose crc32 of the id leaves 1 by 3 are held out: their labels are never used. Ids, sources and
    languages are no inputs. Where labels are missing or all alike, all scores are the smoothed rate.
    Equal texts have equal scores; of labels of one id the majority counts, a tie as 1; an empty table
    gives no rows; other columns are not read.
    """
    spark = df.sparkSession
    docs = documents(df, id_col, text_col)
    send = spark.sparkContext.broadcast
    restorer = send(Restorer(character_model(docs)))
    some = bounded(written(training_labels(labels, id_col, label_col)), MAX_LABELLED)
    texts = written(_distinct(docs.join(F.broadcast(some), "doc_id")).select("label", "text"))
    totals = {r["label"]: r["n"] for r in texts.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    cues = send(_cues(texts, lambda: Reader(restorer.value), totals))

    @pandas_udf("array<double>")
    def evidence(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        read = Reader(restorer.value, cues.value)
        for part in parts:
            yield pd.Series([read.evidence(t) for t in part], dtype=object)

    rows = texts.select("label", evidence("text").alias("x")).toPandas()
    model = Logistic(np.array(rows["x"].tolist(), dtype=float).reshape(-1, 5), rows["label"].to_numpy(dtype=float))
    terms = [F.lit(float(model.w[0]))]
    for i, w in enumerate(model.w[1:]):
        mean, scale = (float(model.mean[i]), float(model.scale[i])) if len(rows) else (0.0, 1.0)
        terms.append(F.lit(float(w)) * (F.col("x")[i] - mean) / scale)
    score = 1 / (1 + F.exp(-sum(terms[1:], terms[0])))
    scored = docs.select("doc_id", held_out("doc_id").alias("held_out"), evidence("text").alias("x"))
    scored = scored.select("doc_id", "held_out", score.alias("score"), F.round(F.exp(F.col("x")[3]) - 1).cast("int").alias("n_cues"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_cues")
