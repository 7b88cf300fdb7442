"""Quality classifier by hierarchical empirical Bayes.

A document's own evidence is the log odds of a logistic regression on its text alone: rates of characters,
words and lines, and the mean log odds of its words, which for the rows of the fit come from the other half of them. The rates of good
documents by host and by path come from grouped aggregation over all labelled documents to learn from: a
host's rate is shrunk towards the global rate, a path's towards its host's, each by a strength estimated
from the spread of the observed rates (moments of a beta-binomial). A site without labels adds nothing.
The score joins both: log odds of the document, plus those of its path less the global ones.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from faunaflow.llm.common import small_batches, written
from faunaflow.llm.learning import Logistic, bounded, held_out, training_labels
from faunaflow.llm.words import word_hashes

#: Labelled rows that the regression is fitted on, at most; rates use all.
MAX_LABELLED = 40_000
THRESHOLD = 0.5
#: Words are counted by hash, in so many places.
PLACES = 1 << 16
#: Sites that may be broadcast; more are joined by a shuffle.
BROADCAST_SITES = 200_000

OUTPUTS = ["q_id", "q_held_out", "q_evidence", "q_host_rate", "q_path_rate", "q_score", "q_keep"]
UPPER, LOWER, DIGITS = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58))
SYMBOLS = b"!%$&*#@|<>/\\^~_=+{}[]"


def measures(text: bytes) -> list[float]:
    """Rates of characters, words and lines of a text."""
    n, words = max(1, len(text)), text.split()
    m = max(1, len(words))
    count = lambda chars: n - len(text.translate(None, chars)) if text else 0
    lines = text.split(b"\n")
    return [
        count(UPPER) / n,
        count(LOWER) / n,
        count(DIGITS) / n,
        count(SYMBOLS) / n,
        count(b".,;:") / n,
        len(set(words)) / m,
        len(b"".join(words)) / m / 10,
        len(set(lines)) / len(lines),
        np.log1p(len(words)),
        text.count(b"|") / m,
        text.count(b"!") / m,
        max(Counter(words).values(), default=0) / m,
        len(words) / len(lines) / 50,
    ]


def word_places(texts) -> Iterator[np.ndarray]:
    """The distinct places of each text's words, in lower case."""
    for group in word_hashes(t.lower() for t in texts):
        for words in group:
            yield np.unique((words % PLACES).astype(np.int64))


def _matrix(texts, odds: np.ndarray, which=None) -> np.ndarray:
    """The measures of each text, and the mean odds of its words, from the first row of ``odds`` or the row named for each."""
    texts = list(texts)
    rows = [0] * len(texts) if which is None else which
    means = [float(odds[k][p].mean()) if len(p) else 0.0 for k, p in zip(rows, word_places(texts))]
    return np.array([[*measures(t), m] for t, m in zip(texts, means)], dtype=float).reshape(-1, 14)


def word_odds(counts: np.ndarray) -> np.ndarray:
    """Log odds by place from the numbers of bad and good texts that have a word there, each total in place -1."""
    bad, good = counts
    return np.log((good[:-1] + 0.5) / (good[-1] + 1)) - np.log((bad[:-1] + 0.5) / (bad[-1] + 1))


class Evidence(NamedTuple):
    model: Logistic
    odds: np.ndarray


def _fit(docs: DataFrame, train: DataFrame) -> Evidence:
    """The regression, fitted on a bounded sample; what comes to the driver has that bound and PLACES numbers."""
    some = bounded(train, MAX_LABELLED).select(F.col("doc_id").alias("q_labelled"), F.col("label").alias("q_label"))
    texts = docs.join(F.broadcast(some), F.col("q_id") == F.col("q_labelled"))
    half = F.pmod(F.xxhash64("q_id"), F.lit(2)).cast("int")
    texts = written(texts.select(half.alias("half"), F.col("q_label").alias("label"), F.col("q_text").alias("text")))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 2, PLACES + 1), dtype=np.int64)
        for batch in batches:
            keys = zip(batch.column("half").to_pylist(), batch.column("label").to_pylist())
            for (half_, label), found in zip(keys, word_places(t.as_py() for t in batch.column("text"))):
                total[half_, label, found] += 1
                total[half_, label, PLACES] += 1
        at = np.argwhere(total)
        yield pa.RecordBatch.from_arrays([pa.array(at[:, 0]), pa.array(at[:, 1]), pa.array(at[:, 2]), pa.array(total[tuple(at.T)])], ["half", "label", "place", "n"])

    rows = texts.mapInArrow(counted, "half long, label long, place long, n long").groupBy("half", "label", "place").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((2, 2, PLACES + 1), dtype=np.int64)
    counts[rows["half"], rows["label"], rows["place"]] = rows["n"]
    halves = np.stack([word_odds(counts[1]), word_odds(counts[0])])

    @pandas_udf("array<double>")
    def measured(texts: pd.Series, half: pd.Series) -> pd.Series:
        return pd.Series(list(_matrix(texts, halves, half.to_numpy()) if len(texts) else []))

    rows = texts.select("label", measured("text", "half").alias("x")).toPandas()
    model = Logistic(np.array(rows["x"].tolist(), dtype=float).reshape(-1, 14), rows["label"].to_numpy(dtype=float))
    return Evidence(model, word_odds(counts.sum(0)))


def _strength(rates: DataFrame, n: str, y: str, towards: Column, groups: int) -> float:
    """Prior strength from the spread of y / n around its target; large where the spread is what chance gives."""
    p = F.col(y) / F.col(n)
    r = rates.agg(
        F.sum(F.col(n) * (p - towards) ** 2).alias("spread"),
        F.sum(F.col(n) * towards * (1 - towards)).alias("chance"),
        F.sum(n).alias("total"),
        F.sum(F.col(n) * F.col(n)).alias("squares"),
        F.count(F.lit(1)).alias("sites"),
    ).first()
    free = r["sites"] - groups
    if not r["total"] or free <= 0 or not r["chance"]:
        return 1e4
    variance = r["chance"] / r["total"]
    room = r["total"] - r["squares"] / r["total"] - free
    rho = (r["spread"] / variance - free) / room if room > 0 else 0.0
    return 1 / min(max(rho, 1e-4), 0.9) - 1


def _sites(docs: DataFrame, train: DataFrame) -> tuple[DataFrame, DataFrame, float]:
    """Rates by path and by host, shrunk, and the global rate."""
    placed = docs.select("q_id", "q_host", "q_path").join(train, F.col("q_id") == F.col("doc_id"))
    paths = written(placed.groupBy("q_host", "q_path").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("y")))
    hosts = paths.groupBy("q_host").agg(F.sum("n").alias("hn"), F.sum("y").alias("hy"))
    total = hosts.agg(F.sum("hn").alias("n"), F.sum("hy").alias("y")).first()
    rate = ((total["y"] or 0) + 0.5) / ((total["n"] or 0) + 1)
    a = _strength(hosts, "hn", "hy", F.lit(rate), 1)
    hosts = hosts.select("q_host", ((F.col("hy") + a * rate) / (F.col("hn") + a)).alias("host_rate"))
    both = paths.join(hosts, "q_host")
    b = _strength(both, "n", "y", F.col("host_rate"), hosts.count())
    paths = both.select("q_host", "q_path", ((F.col("y") + b * F.col("host_rate")) / (F.col("n") + b)).alias("path_rate"))
    return written(paths), written(hosts), rate


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_SITES + 1).count() <= BROADCAST_SITES else df


def quality(
    df: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_cols: tuple[str, ...] = ("source",),
    path_cols: tuple[str, ...] = ("lang",),
    label_col: str = "quality",
) -> DataFrame:
    """The rows and columns of df, with q_id, q_held_out, q_evidence, q_host_rate, q_path_rate, q_score and q_keep.

    q_score is the probability that the document is good, q_keep whether it is at least 0.5. Null texts are empty, null
    parts of a host or path are empty strings. Where labels are missing or all alike, the score is the
    smoothed rate of what there is, 0.5 of nothing. Columns of df with exactly one of these names are
    replaced, all others stay. Labels of held-out rows are never used; of labels of one id the majority
    counts, a tie as good. Repeated rows are each returned; an empty table gives no rows.
    """
    small_batches(df.sparkSession)
    joined = lambda cols: F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])
    stay = [c for c in df.columns if c not in OUTPUTS]
    # the columns of df travel in one struct, so none of their names can clash
    docs = df.select(
        F.struct(*stay).alias("q_row"),
        F.col(id_col).alias("q_id"),
        F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("q_text"),
        joined(host_cols).alias("q_host"),
        joined(host_cols + path_cols).alias("q_path"),
    )
    train = written(training_labels(labels, id_col, label_col))
    fitted = _fit(docs, train)
    sent = df.sparkSession.sparkContext.broadcast(fitted)
    paths, hosts, rate = _sites(docs, train)

    @pandas_udf("double")
    def evidence(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model, odds = sent.value
        for part in texts:
            yield pd.Series(model.logit(_matrix(part, odds[None])) if len(part) else [], dtype="float64")

    scored = docs.withColumn("q_evidence", evidence("q_text")).drop("q_text")
    # beyond the bound, these joins read two shuffles each, so that Spark may split a host that is hot
    scored = scored.join(_small(paths), ["q_host", "q_path"], "left").join(_small(hosts), "q_host", "left")
    host_rate = F.coalesce("host_rate", F.lit(rate))
    path_rate = F.coalesce("path_rate", host_rate)
    odds = lambda p: F.log(p / (1 - p))
    score = 1 / (1 + F.exp(-(F.col("q_evidence") + odds(path_rate) - F.lit(float(np.log(rate / (1 - rate)))))))
    return scored.select(
        "q_row.*",
        "q_id",
        held_out("q_id").alias("q_held_out"),
        "q_evidence",
        host_rate.alias("q_host_rate"),
        path_rate.alias("q_path_rate"),
        score.alias("q_score"),
        (score >= THRESHOLD).alias("q_keep"),
    )
