"""Substring deduplication by difference-cover anchors.

A difference cover D of a period v has, for every two positions, an offset below v that moves both into
D modulo v. So windows of WIDTH - v + 1 words are hashed only at positions in D: any two equal windows
of WIDTH words share such an anchor at the same offset. Anchors that two documents share then extend: the
full windows around them are hashed, in 96 bits, and each window's least document is found exactly.
Anchors and windows that are hot in a bounded sample are dealt out over salts; a hot window's least document comes
from an aggregation that is combined before its shuffle. No pairs are formed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faunaflow.llm.common import documents, sample_fraction, settled, written
from faunaflow.llm.words import SECOND, window_hashes, word_hashes

WIDTH = 50
#: A perfect difference set, every residue modulo 31 is a difference of two of them.
PERIOD, COVER = 31, [1, 5, 11, 24, 25, 27]
ANCHOR = WIDTH - PERIOD + 1
#: Sample for hot anchors and windows, which decides only how rows are dealt out.
SAMPLE_ROWS, HOT_SHARE, SALTS = 16_384, 0.001, 128
#: Stands for a null id, larger than any other.
NO_ID = (1 << 63) - 1
#: Texts without an id are dealt out over so many keys.
SPREAD = 4096
#: What tells one row from others: an id, where it is null a part of the text's hash, and among rows of one id
#: the place of the text's hash.
ROW = ["key", "spread", "nth"]


def anchor_places(n_words: int) -> np.ndarray:
    """Starts of the anchors of a text of so many words; none where no full window fits."""
    if n_words < WIDTH:
        return np.empty(0, dtype=np.int64)
    places = (np.arange(0, n_words, PERIOD)[:, None] + np.array(COVER)).ravel()
    return places[places + ANCHOR <= n_words]


def window_starts(places: np.ndarray, n_words: int) -> np.ndarray:
    """Starts of the full windows that hold an anchor at one of these places at an offset below the period.

    Places beyond the text, from a longer one under the same key, are passed over.
    """
    places = places[places + ANCHOR <= n_words]
    edge = np.zeros(n_words + 2, dtype=np.int64)
    np.add.at(edge, np.maximum(places - PERIOD + 1, 0), 1)
    np.add.at(edge, places + 1, -1)
    return np.flatnonzero(np.cumsum(edge)[: max(0, n_words - WIDTH + 1)] > 0)


def _is_in(h: np.ndarray, hot: np.ndarray) -> np.ndarray:
    return hot[np.minimum(np.searchsorted(hot, h), len(hot) - 1)] == h if len(hot) else np.zeros(len(h), dtype=bool)


def _hot(docs: DataFrame) -> dict[str, np.ndarray]:
    """Sorted hashes of the anchors, and of the full windows, in at least HOT_SHARE of a sample of documents."""
    part = docs.sample(False, sample_fraction(docs, SAMPLE_ROWS), seed=3).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in word_hashes(t.as_py() for t in batch.column(0)):
                for words in group:
                    a = np.unique(window_hashes(words, ANCHOR)[anchor_places(len(words))])
                    w = np.unique(window_hashes(words, WIDTH))
                    yield pa.RecordBatch.from_arrays([pa.array(np.r_[a, w]), pa.array(np.r_[np.zeros(len(a), bool), np.ones(len(w), bool)])], ["h", "full"])

    counts = part.mapInArrow(run, "h long, full boolean").groupBy("h", "full").agg(F.count(F.lit(1)).alias("c"))
    found = counts.where(F.col("c") >= max(16, int(SAMPLE_ROWS * HOT_SHARE))).select("h", "full").toPandas()
    return {name: np.sort(found["h"][found["full"] == full].to_numpy(dtype=np.int64)) for name, full in (("anchor", False), ("window", True))}


def _anchors(docs: DataFrame, hot) -> DataFrame:
    """h, hot, key, spread, at: the anchors of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, spread, done = batch.column("key").to_numpy(), batch.column("spread").to_numpy(), 0
            for group in word_hashes(t.as_py() for t in batch.column("text")):
                places = [anchor_places(len(w)) for w in group]
                h = np.concatenate([window_hashes(w, ANCHOR)[p] for w, p in zip(group, places)])
                here, each = slice(done, done + len(group)), [len(p) for p in places]
                columns = [h, _is_in(h, hot.value["anchor"]), np.repeat(keys[here], each), np.repeat(spread[here], each), np.concatenate(places).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["h", "hot", "key", "spread", "at"])
                done += len(group)

    return docs.select("key", "spread", "text").mapInArrow(run, "h long, hot boolean, key long, spread int, at int")


def _windows(docs: DataFrame, places: DataFrame, hot) -> DataFrame:
    """h, more, hot, key, spread, nth, at: the full windows around the shared anchors, h and more their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, done = [batch.column(c).to_numpy() for c in ROW], 0
            anchors = batch.column("places")
            for group in word_hashes(t.as_py() for t in batch.column("text")):
                at = [window_starts(anchors[done + i].values.to_numpy().astype(np.int64), len(w)) for i, w in enumerate(group)]
                h = np.concatenate([window_hashes(w, WIDTH)[a] for w, a in zip(group, at)])
                more = np.concatenate([window_hashes(w, WIDTH, SECOND)[a] for w, a in zip(group, at)])
                here, each = slice(done, done + len(group)), [len(a) for a in at]
                columns = [h, (more >> 32).astype(np.int32), _is_in(h, hot.value["window"]), *(np.repeat(r[here], each) for r in rows), np.concatenate(at).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["h", "more", "hot", *ROW, "at"])
                done += len(group)

    # all columns of docs, so that one shuffle of the texts serves the final pass too
    return docs.join(places, ["key", "spread"]).mapInArrow(run, "h long, more int, hot boolean, key long, spread int, nth int, at int")


def _kept(docs: DataFrame, repeats: DataFrame) -> DataFrame:
    schema = docs.select("doc_id").schema.add("n_words", "long").add("n_removed", "long").add("kept", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals, removed, kept = [], [], []
            for text, starts in zip(batch.column("text"), batch.column("starts")):
                words = text.as_py().split()
                totals.append(len(words))
                if not starts.is_valid:
                    removed.append(0)
                    kept.append(b" ".join(words))
                    continue
                edge = np.zeros(len(words) + 1, dtype=np.int64)
                at = starts.values.to_numpy().astype(np.int64)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + WIDTH, -1)
                stay = np.cumsum(edge)[:-1] == 0
                removed.append(int(len(words) - stay.sum()))
                kept.append(b" ".join([words[i] for i in np.flatnonzero(stay)]))
            text = pa.array(kept, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), text], schema.names)

    joined = docs.join(repeats, ROW, "left").select("doc_id", "text", "starts")
    return joined.mapInArrow(run, schema)


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept: every document without the passages that an earlier one has.

    A word is removed where a window of 50 consecutive words covers it whose words also stand in a row in a
    document with a smaller id; windows are judged on the input. Kept words are joined by one space. Words
    lie between ASCII white space; null text has none. A null id is larger than any other and smaller
    than none; rows that share an id do not remove each other's words. An empty table gives no rows;
    other columns are not read. Windows are compared by hashes of 96 bits: of n windows about n * n / 2^97 pairs
    are taken for equal that are not, one in a thousand corpora of 10^13.
    """
    docs = documents(df, id_col, text_col)
    total = F.xxhash64("text")
    docs = docs.select(
        "doc_id",
        F.coalesce("doc_id", F.lit(NO_ID)).alias("key"),
        F.when(F.isnull("doc_id"), F.pmod(total, F.lit(SPREAD))).otherwise(F.lit(0)).cast("int").alias("spread"),
        total.alias("sum"),
        F.col("text").cast("binary").alias("text"),
    )
    hot = df.sparkSession.sparkContext.broadcast(_hot(docs))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("key"), F.lit(SALTS))).otherwise(F.lit(0).cast("long"))
    # an anchor that is hot in the sample is shared
    same = Window.partitionBy("h", "salt")
    anchors = _anchors(docs, hot).withColumn("salt", salt)
    anchors = anchors.select("key", "spread", "at", (F.col("hot") | (F.min("key").over(same) != F.max("key").over(same))).alias("shared")).where("shared")
    places = written(anchors.groupBy("key", "spread").agg(F.collect_set("at").alias("places")))
    # before the texts are shuffled, the anchors' files may go; at the end of the next phase only the texts are still read
    settled(df)
    rows = docs.withColumn("nth", F.dense_rank().over(Window.partitionBy("key", "spread").orderBy("sum")))
    windows = _windows(rows, places, hot).withColumn("salt", salt)
    same = Window.partitionBy("h", "more", "salt")
    each = windows.select("h", "more", "hot", *ROW, "at", F.min("key").over(same).alias("first"))
    least = windows.where("hot").groupBy("h", "more").agg(F.min("key").alias("least"))
    repeated = each.join(F.broadcast(least), ["h", "more"], "left").where("key > coalesce(least, first)")
    starts = written(repeated.groupBy(*ROW).agg(F.collect_set("at").alias("starts")))
    settled(df)
    return _kept(rows, starts)
