"""Divergence of the sources of each language, with strings materialised late.

Tasks count terms by language and source and write them once, unshuffled, with a digest of 64 bits for each term. From there only
digests and counts are shuffled, until the terms that enough documents hold are known. Strings are then read back twice:
as least and largest string of each kept digest, which differ where a digest stands for several terms (these few are
split, by a number for each of their terms), and for the terms that are returned.

All numbers are integers. With f the divergence of two scaled frequencies and z the frequency that a source gives to a term that it
does not hold, the sum over all V kept terms for sources s and t is

    V * f(zs, zt) + E(s, t) + E(t, s) + J(s, t)

where E(s, t) sums f(ps, zt) - f(zs, zt) over the terms of s, from how many terms s has of each frequency, and J corrects for
the terms that both hold. J is summed in the tasks, so that neither absent terms nor pairs within a term become rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faunaflow.llm.common import small_batches, written

#: Documents of a language that a kept term must occur in, ranks of terms, the scale of frequencies.
MIN_DOCS, TERMS, SCALE = 10, 10, 1_000_000_000
#: Entries that a task counts before it writes them, pairs of sources that it sums at once; they bound memory, not results.
ENTRIES, PAIRS = 800_000, 1_000_000
#: Kept terms that may be broadcast (a language and 12 bytes each); more are joined by a shuffle.
BROADCAST_TERMS = 1_000_000
DIGEST_BITS = 64
#: Bytes as they count in terms: A-Z as a-z, other letters and all that is not ASCII as they are, the rest as a blank.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _plain(df: DataFrame, lang: str, source: str) -> DataFrame:
    return df.select(F.coalesce(F.col(lang), F.lit("")).alias("lang"), F.coalesce(F.col(source), F.lit("")).alias("source"), "*")


def term_counts(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", digest_bits: int = DIGEST_BITS) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents), digest: summed within tasks, a term may have several rows."""
    small_batches(df.sparkSession)
    texts = _plain(df.select(F.col(lang_col).alias("l"), F.col(source_col).alias("s"), F.col(text_col).cast("binary").alias("t")), "l", "s")

    def rows(seen: dict) -> pa.RecordBatch:
        lists = [[], [], [], [], []]
        for (lang, source), (n, docs) in seen.items():
            for column, values in zip(lists, ([lang] * len(n), [source] * len(n), n.keys(), n.values(), map(docs.__getitem__, n))):
                column += values
        terms = pa.array(lists[2], pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([pa.array(lists[0], pa.string()), pa.array(lists[1], pa.string()), terms, *(pa.array(x, pa.int64()) for x in lists[3:])], ["lang", "source", "term", "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        for batch in batches:
            for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "t"))):
                words = (text or b"").translate(LETTERS).split()
                n, docs = seen.setdefault((lang, source), (Counter(), Counter()))
                n.update(words)
                docs.update(set(words))
            if sum(len(n) for n, _ in seen.values()) > ENTRIES:
                yield rows(seen)
                seen = {}
        yield rows(seen)

    counted = texts.select("lang", "source", "t").mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return counted.withColumn("digest", F.shiftrightunsigned(F.xxhash64("term"), 64 - digest_bits) if digest_bits < 64 else F.xxhash64("term"))


def _enough(rows: DataFrame, key: list[str], min_docs: int) -> DataFrame:
    return rows.groupBy("lang", *key).agg(F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).select("lang", *key)


def _sent(df: DataFrame) -> DataFrame:
    """A table that was written, marked for broadcast if it is counted to be small enough."""
    return F.broadcast(df) if df.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS else df


def kept_terms(counts: DataFrame, min_docs: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(terms: digest, nth, term; kept: lang, digest, nth; cells: lang, source, digest, nth, n of the kept terms).

    nth is 0 but for a digest of several terms, where it numbers them in their order. Documents are counted first, by language
    and digest alone; what the kept digests do not match is not shuffled again.
    """
    kept = written(_enough(counts.select("lang", "digest", "docs"), ["digest"], min_docs))
    digests = _sent(written(kept.select("digest").distinct()))
    wanted = counts.select("digest", "term").join(digests, "digest", "left_semi")
    strings = written(wanted.groupBy("digest").agg(F.min("term").alias("term"), F.max("term").alias("last")))
    terms, first = strings.where("term = last").select("digest", F.lit(0).alias("nth"), "term"), F.lit(0).alias("nth")
    cells = counts.select("lang", "source", "digest", "n").join(_sent(kept), ["lang", "digest"], "left_semi")
    cells = cells.groupBy("lang", "source", "digest").agg(F.sum("n").alias("n")).select("lang", "source", "digest", first, "n")
    kept = kept.select("lang", "digest", first)
    shared = strings.where("term <> last").select("digest")
    if not shared.isEmpty():
        several = wanted.join(shared, "digest", "left_semi").distinct()
        names = written(several.withColumn("nth", F.row_number().over(Window.partitionBy("digest").orderBy("term"))).select("digest", "nth", "term"))
        split = counts.join(names, ["digest", "term"]).groupBy("lang", "source", "digest", "nth").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        split = written(split)
        more = written(_enough(split, ["digest", "nth"], min_docs))
        cells = cells.join(shared, "digest", "left_anti").select("lang", "source", "digest", "nth", "n").unionByName(
            split.join(more, ["lang", "digest", "nth"], "left_semi").select("lang", "source", "digest", "nth", "n")
        )
        kept = kept.join(shared, "digest", "left_anti").select("lang", "digest", "nth").unionByName(more)
        terms = terms.unionByName(names.select("digest", "nth", "term"))
    return terms, kept, written(cells)


def _frequency(n: str, total: str, terms: str) -> str:
    """The scaled frequency of a count, exactly: 1 + floor(SCALE * (n + 2) / (total + 2 * terms))."""
    return f"1 + (cast({SCALE} as decimal(10, 0)) * cast({n} + 2 as decimal(20, 0))) div cast({total} + 2 * {terms} as decimal(20, 0))"


def _f(p: str, q: str) -> str:
    return f"((({p}) - ({q})) * (({p}) - ({q}))) div (({p}) + ({q}))"


def _both(held: DataFrame) -> DataFrame:
    """lang, a, b, value: J of each two sources a < b, from rows (lang, held: array of place, p, z) for each term."""

    def f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (p - q) ** 2 // (p + q)

    def products(lists: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(a, b, value) of the terms of so many sources each, some at a time."""
        place, p, z = lists
        m, k = place.shape
        terms = max(1, PAIRS // (k * k))
        sources = max(1, PAIRS // (k * terms))
        for t in range(0, m, terms):
            here = slice(t, t + terms)
            for s in range(0, k, sources):
                left = [x[here, s : s + sources, None] for x in lists]
                right = [x[here, None, :] for x in lists]
                value = f(left[1], right[1]) - f(left[1], right[2]) - f(left[2], right[1]) + f(left[2], right[2])
                a, b = np.broadcast_to(left[0], value.shape), np.broadcast_to(right[0], value.shape)
                yield a[a < b], b[a < b], value[a < b]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pd.DataFrame] = []
        size = 0

        def summed() -> pd.DataFrame:
            return pd.concat(parts).groupby(["lang", "a", "b"], as_index=False, sort=False)["value"].sum()

        for batch in batches:
            column = batch.column("held")
            ends, flat = column.offsets.to_numpy(), column.flatten()
            values = [flat.field(i).to_numpy() for i in range(3)]
            ends = ends - ends[0]
            lang = np.array(batch.column("lang").to_pylist(), dtype=object)
            sizes = np.diff(ends)
            for name in set(lang):
                for k in np.unique(sizes[lang == name]):
                    starts = ends[:-1][(lang == name) & (sizes == k)]
                    for a, b, value in products([v[starts[:, None] + np.arange(k)] for v in values]) if k > 1 else ():
                        parts.append(pd.DataFrame({"a": a, "b": b, "value": value}).groupby(["a", "b"], as_index=False, sort=False).sum().assign(lang=name))
                        size += len(parts[-1])
                        if size > PAIRS:
                            parts = [summed()]
                            size = len(parts[0])
                            if size > PAIRS // 2:
                                yield pa.RecordBatch.from_pandas(parts.pop()[["lang", "a", "b", "value"]], preserve_index=False)
                                size = 0
        if parts:
            yield pa.RecordBatch.from_pandas(summed()[["lang", "a", "b", "value"]], preserve_index=False)

    return held.select("lang", "held").mapInArrow(run, "lang string, a int, b int, value long")


def source_pairs(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value: the divergence of each source of a language from each other one.

    ``groups`` has lang, source, place, total, terms and z; ``cells`` has lang, source, place, digest, nth, p and z.
    """
    one = groups.select("lang", F.col("place").alias("a"), F.col("z").alias("za"), "terms")
    other = groups.select("lang", F.col("place").alias("b"), F.col("z").alias("zb"))
    base = one.join(other, "lang").where("a <> b").select("lang", "a", "b", F.expr(f"if(terms = 0, 0L, terms * ({_f('za', 'zb')}))").alias("value"))
    often = cells.groupBy("lang", F.col("place").alias("a"), F.col("z").alias("za"), "p").agg(F.count(F.lit(1)).alias("h"))
    alone = often.join(other, "lang").where("a <> b").select("lang", "a", "b", F.expr(f"h * ({_f('p', 'zb')} - {_f('za', 'zb')})").alias("value"))
    held = cells.groupBy("lang", "digest", "nth").agg(F.collect_list(F.struct("place", "p", "z")).alias("held")).where("size(held) > 1")
    joint = _both(held)
    turned = lambda df: df.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value")
    alone = alone.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    rows = base.unionByName(alone).unionByName(turned(alone)).unionByName(joint).unionByName(turned(joint))
    sums = rows.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    name = lambda place, to: groups.select("lang", F.col("place").alias(place), F.col("source").alias(to))
    return sums.join(name("a", "source"), ["lang", "a"]).join(name("b", "item"), ["lang", "b"]).select("lang", "source", "item", "value")


def top_terms(cells: DataFrame, groups: DataFrame, terms: DataFrame, ranks: int) -> DataFrame:
    """lang, source, item, value, rank: the terms that a source has more often than its language.

    Ranks by value come from digests alone, first within tasks; of the terms that share the last rank the strings decide.
    """
    langs = groups.groupBy("lang").agg(F.sum("total").alias("all"), F.first("terms").alias("terms"))
    whole = cells.groupBy("lang", "digest", "nth").agg(F.sum("n").alias("n")).join(langs, "lang")
    whole = whole.select("lang", "digest", "nth", F.expr(_frequency("n", "all", "terms")).alias("q"))
    over = cells.join(whole, ["lang", "digest", "nth"]).where("p > q").select("lang", "source", "digest", "nth", F.expr(_f("p", "q")).alias("value"))
    group = Window.partitionBy("lang", "source")
    first = over.withColumn("place", F.rank().over(group.orderBy(F.desc("value")))).where(F.col("place") <= ranks)
    named = first.join(terms, ["digest", "nth"]).select("lang", "source", F.col("term").alias("item"), "value")
    return named.withColumn("rank", F.row_number().over(group.orderBy(F.desc("value"), "item"))).where(F.col("rank") <= ranks)


def source_divergence(
    df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS, ranks: int = TERMS, digest_bits: int = DIGEST_BITS
) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank.

    Part ``pair`` has, for each source of each language, every other source of it by divergence over all kept terms, 0 where the language
    keeps none; part ``term`` the ``ranks`` terms by which the source differs most from its language, of those it has more often.
    Terms are runs of letters and of characters beyond ASCII, with only A-Z lower-cased; a language keeps those in at least
    ``min_docs`` of its documents. Null text, language and source are empty; repeated rows count each; of equal values the lesser item by
    UTF-8 comes first. A source alone in its language has no pair rows. An empty table gives no rows; other columns are not read.
    """
    counts = written(term_counts(df, text_col, lang_col, source_col, digest_bits))
    terms, kept, cells = kept_terms(counts, min_docs)
    present = _plain(df.select(F.col(lang_col).alias("l"), F.col(source_col).alias("s")), "l", "s").select("lang", "source").distinct()
    sizes = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    many = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"))
    groups = present.join(sizes, ["lang", "source"], "left").join(many, "lang", "left").na.fill(0, ["total", "terms"])
    groups = groups.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("source")))
    groups = written(groups.withColumn("z", F.expr(f"if(terms = 0, 0L, {_frequency('0L', 'total', 'terms')})")))
    cells = written(cells.join(groups, ["lang", "source"]).select(*cells.columns, "place", "z", F.expr(_frequency("n", "total", "terms")).alias("p")))
    pairs = source_pairs(cells, groups)
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    best = top_terms(cells, groups, terms, ranks)
    columns = lambda rows, part: rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return columns(pairs, "pair").unionByName(columns(best, "term"))
