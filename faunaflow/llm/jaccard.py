"""Exact Jaccard self-join of documents on word shingles, by prefix filters under several global orders.

1. Shingle sets become sorted 64-bit hashes; equal sets are one class (128 bits) with its least document.
2. By hash (tokens that are hot in a bounded sample last) each class emits a lengthened prefix. Linked
   classes share so many tokens of it that a class whose prefix has fewer shared tokens can have no link.
   A sample decides only the order, and any fixed order is exact.
3. The classes left get prefixes under three orders, all rarest first: by exact document frequency, and
   by its power of two with two hashes in its place. A candidate pair shares a token of both first
   prefixes, in sizes and at positions that leave room for the overlap needed, and then a token of both
   second and of both third prefixes. Only pairs that all orders let through have their sets fetched.
4. Candidates are taken in rounds of stars: in each token's group one class is the pivot for the others.
   Only classes that no verified link connects yet are paired in the last, complete round, by token and by
   size. So a group of m near copies costs about m comparisons, not m * m, and components stay exact.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faunaflow.llm.common import documents, dropped, sample_fraction, settled, written
from faunaflow.llm.components import components
from faunaflow.llm.words import mix, window_hashes, word_hashes

WORDS = 5
#: Sample for the order: so many documents, hot from this share on, which bounds the share of all documents that
#: one token's task may hold before step 3; and the longest list of hot tokens, the hottest of them (16 bytes each).
SAMPLE_ROWS, HOT_SHARE, HOT_TOKENS = 16_384, 0.001, 1_000_000
#: Classes whose ids may be broadcast (16 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
STAR_ROUNDS = 2
#: Classes that a task remembers before it starts anew; a class seen again only repeats its prefix.
REMEMBERED = 1_000_000
HOT = 1 << 40
#: Fixed values that make the second and third order.
ORDERS = [0x5851F42D4C957F2D, 0x14057B7EF767814F]
#: A prefix of a quarter is exact for a similarity of 3/4; it is lengthened by 1/12 of the set.
LONGER, SHARED = 12, 16


def shingle_sets(texts: Iterator[bytes], k: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; fewer than k words are one shingle, none are none."""
    for group in word_hashes(t.lower() for t in texts):
        for words in group:
            yield np.unique(window_hashes(words, min(k, len(words)))) if len(words) else np.empty(0, np.int64)


def _class_of(shingles: np.ndarray) -> tuple[int, int]:
    """Two hashes of 64 bits of a set."""
    return struct.unpack("<qq", hashlib.blake2b(shingles.tobytes(), digest_size=16).digest())


def _binary(docs: DataFrame) -> DataFrame:
    return docs.withColumn("text", F.col("text").cast("binary"))


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.r_[0, np.cumsum([len(a) for a in arrays])].astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def hot_tokens(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the shingles in at least HOT_SHARE of a sample, and in how many of its documents each is.

    Texts may be long, so the list is bounded whatever their length; any list gives an exact order.
    """
    part = _binary(docs.sample(False, sample_fraction(docs, SAMPLE_ROWS), seed=5)).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in shingle_sets(t.as_py() for t in batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(s)], ["token"])

    counts = part.mapInArrow(run, "token long").groupBy("token").agg(F.count(F.lit(1)).alias("c"))
    hot = counts.where(F.col("c") >= max(16, int(SAMPLE_ROWS * HOT_SHARE))).orderBy(F.desc("c"), "token").limit(HOT_TOKENS).toPandas().sort_values("token")
    return hot["token"].to_numpy(dtype=np.int64), hot["c"].to_numpy(dtype=np.int64)


def _is_in(s: np.ndarray, hot: np.ndarray) -> np.ndarray:
    return hot[np.minimum(np.searchsorted(hot, s), len(hot) - 1)] == s if len(hot) else np.zeros(len(s), dtype=bool)


def _classes(docs: DataFrame, hot) -> DataFrame:
    """doc_id, sum, cls, more, n, and the lengthened hash-order prefix: cold and hot tokens, once for each class in a task."""
    schema = docs.select("doc_id", "sum", *[F.lit(0).cast("long").alias(c) for c in ("cls", "more", "n")]).schema
    for name in ("cold", "hot"):
        schema = schema.add(name, T.ArrayType(T.LongType()))
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        nothing = np.empty(0, dtype=np.int64)
        for batch in batches:
            cls, n, cold, late = [], [], [], []
            for s in shingle_sets(t.as_py() for t in batch.column("text")):
                c, size = _class_of(s), len(s)
                cls.append(c)
                n.append(size)
                if size == 0 or c in seen:
                    cold.append(nothing)
                    late.append(nothing)
                    continue
                if len(seen) > REMEMBERED:
                    seen.clear()
                seen.add(c)
                is_hot = _is_in(s, hot.value[0])
                length = size // 4 + 1 + size // LONGER
                cold.append(s[~is_hot][:length])
                late.append(s[is_hot][: length - len(cold[-1])])
            ids = [pa.array([c[k] for c in cls], pa.int64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("sum"), *ids, pa.array(n, pa.int64()), _lists(cold), _lists(late)], names)

    return _binary(docs).mapInArrow(run, schema)


def _told_apart(classes: DataFrame) -> DataFrame:
    """Classes that share the first hash but not the second get another first hash.

    Of n classes about n * n / 2^65 collide, 70 of 5 * 10^10; these few are listed on the driver.
    """
    both = classes.where("n > 0").groupBy("cls").agg(F.min("more").alias("lo"), F.max("more").alias("hi"))
    same = [r["cls"] for r in both.where("lo <> hi").select("cls").collect()]
    return classes.withColumn("cls", F.when(F.col("cls").isin(same), F.xxhash64("cls", "more")).otherwise(F.col("cls"))) if same else classes


def _survivors(classes: DataFrame) -> DataFrame:
    """cls, n of the classes with enough shared tokens in their prefix."""
    cold = classes.select("cls", "n", F.explode("cold").alias("token"))
    by = Window.partitionBy("token")
    shared = cold.select("cls", "n", "token", (F.min("cls").over(by) != F.max("cls").over(by)).alias("shared")).where("shared").drop("shared")
    hot = classes.select("cls", "n", F.explode("hot").alias("token"))
    # the same class may come from several tasks
    rows = shared.unionByName(hot).repartition("cls").groupBy("cls", "n", "token").agg(F.lit(1).alias("one"))
    return rows.groupBy("cls", "n").agg(F.count("one").alias("c")).where(f"c >= n div {SHARED} + 1").select("cls", "n")


def _whole_sets(docs: DataFrame, wanted: DataFrame, hot) -> DataFrame:
    """cls, n, cold, hot: the whole sorted sets of the wanted classes, from their least document's text."""
    found = wanted.select("cls", "more", F.col("rep.doc_id").alias("doc_id"), F.col("rep.sum").alias("rep_sum"))
    small = found.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    texts = _binary(docs).withColumnRenamed("doc_id", "id")
    # a null id is told apart by its text's hash, so the join stays in proportion to the rows
    same = (F.col("sum") == F.col("rep_sum")) & F.col("id").eqNullSafe(F.col("doc_id"))
    texts = texts.join(F.broadcast(found) if small else found, same).select("cls", "more", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls, n, cold, late = [], [], [], []
            wants = zip(batch.column("cls").to_pylist(), batch.column("more").to_pylist())
            for (want, more), s in zip(wants, shingle_sets(t.as_py() for t in batch.column("text"))):
                if _class_of(s)[1] != more:  # another text under the same id
                    continue
                is_hot = _is_in(s, hot.value[0])
                cls.append(want)
                n.append(len(s))
                cold.append(s[~is_hot])
                late.append(s[is_hot])
            yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(n, pa.int64()), _lists(cold), _lists(late)], ["cls", "n", "cold", "hot"])

    return texts.mapInArrow(run, "cls long, n long, cold array<bigint>, hot array<bigint>").dropDuplicates(["cls"])


def _keys(tokens: np.ndarray, order: int) -> np.ndarray:
    return mix(tokens.view(np.uint64) ^ np.uint64(order))


def _prefixes(sets: DataFrame, hot) -> DataFrame:
    """cls, n, u, tokens, places, second, third: the shared tokens of each class's prefix under the three orders.

    ``tokens`` and ``places`` are those of the order of frequency, u is the number of unshared tokens, which come
    first in every order; ``second`` and ``third`` are hashes of 32 bits, which may let a pair through but never hold one back.
    """
    by, n_hot = Window.partitionBy("token"), F.size("hot").alias("n_hot")
    cold = sets.select("cls", "n", n_hot, F.explode("cold").alias("token")).withColumn("c", F.count(F.lit(1)).over(by)).where("c > 1")
    shared = cold.select("cls", "n", "n_hot", F.struct("c", "token").alias("t"))
    own = shared.groupBy("cls", "n", "n_hot").agg(F.collect_list("t").alias("cold"))
    # hot tokens come last in all orders, those that are hottest in the sample behind the others
    late = sets.where("size(hot) > 0").select("cls", "n", n_hot, "hot")
    keys = ["cls", "n", "n_hot"]
    joined = own.join(late, keys, "full").select(*keys, F.col("cold.c").alias("c"), F.col("cold.token").alias("cold"), "hot")
    names = ["cls", "n", "u", "tokens", "places", "second", "third"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {name: [] for name in names}
            column = {name: batch.column(name) for name in batch.schema.names}
            for k, (cls, n, n_hot_) in enumerate(zip(*(column[c].to_pylist() for c in keys))):
                values = [column[c][k].values for c in ("c", "cold", "hot")]
                c, cold_, hot_ = (np.empty(0, np.int64) if v is None else v.to_numpy(zero_copy_only=False) for v in values)
                often = hot.value[1][np.searchsorted(hot.value[0], hot_)]
                tokens, c = np.r_[cold_, hot_], np.r_[c, HOT + often]
                power = np.log2(np.r_[c[: len(cold_)], often]).astype(np.int64) + (c >= HOT) * 64
                u = n - n_hot_ - len(cold_)
                room = max(0, n // 4 + 1 - u)
                if not room:
                    continue
                first = np.lexsort((tokens, c))[:room]
                others = [np.lexsort((_keys(tokens, order), power))[:room] for order in ORDERS]
                row = [cls, n, u, tokens[first], u + np.arange(len(first)), *(np.unique(tokens[o].astype(np.int32)) for o in others)]
                for name, value in zip(names, row):
                    out[name].append(value)
            kinds = [pa.int64()] * 3 + [pa.list_(pa.int64())] * 2 + [pa.list_(pa.int32())] * 2
            yield pa.RecordBatch.from_arrays([pa.array(out[name], kind) for name, kind in zip(names, kinds)], names)

    return joined.mapInArrow(run, "cls long, n long, u long, tokens array<bigint>, places array<bigint>, second array<int>, third array<int>")


#: Of two rows of one token: sizes, and the room that is left behind their places, allow the overlap.
def _room(x: str, y: str) -> str:
    return f"4 * least({x}.n, {y}.n) >= 3 * greatest({x}.n, {y}.n) and 7 * least({x}.n - {x}.i, {y}.n - {y}.i) >= 3 * ({x}.n + {y}.n)"


def _contested(rows: DataFrame, round_: int) -> DataFrame:
    """token with a pivot row, for tokens whose classes are not yet all in one component.

    The class with the fewest unshared tokens is nearest to the middle of a group of near copies, so most
    of the others link to it; every other round draws the pivot by a hash.
    """
    middle = F.col("u") if round_ % 2 == 0 else F.lit(0).cast("long")
    row = F.struct(middle.alias("m"), F.xxhash64(F.lit(round_), "cls").alias("h"), "cls", "n", "i", "comp")
    groups = rows.groupBy("token").agg(F.min(row).alias("p"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    return groups.where("lo <> hi").select("token", "p")


def _star_pairs(rows: DataFrame, pivots: DataFrame) -> DataFrame:
    """For each class the pivot of most of its tokens."""
    met = rows.alias("r").join(pivots.alias("g"), "token").where(f"r.comp <> p.comp and {_room('r', 'p')}")
    met = met.groupBy(F.col("r.cls").alias("x"), F.col("p.cls").alias("y")).agg(F.count(F.lit(1)).alias("c"))
    return met.groupBy("x").agg(F.max(F.struct("c", "y")).alias("best")).select("x", F.col("best.y").alias("y"))


def _open_pairs(rows: DataFrame, pivots: DataFrame, prefixes: DataFrame) -> DataFrame:
    """All candidate pairs of different components: classes outside a token's largest one, with all of its others.

    The sizes of linked classes differ by a third at most, so a step of sizes is a key. A pair leaves the join once, at
    the first token that both first prefixes have, and only if their second prefixes share one as well.
    """
    rows = rows.join(pivots.select("token"), "token", "left_semi").drop("u")
    sizes = rows.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("c"))
    main = written(sizes.groupBy("token").agg(F.max(F.struct("c", "comp")).alias("m")).select("token", F.col("m.comp").alias("main")))
    # what classes of different components share is among these tokens, so no others are carried
    own = rows.groupBy("cls").agg(F.array_sort(F.collect_list(F.struct("i", "token"))).alias("t")).select("cls", F.col("t.token").alias("tokens"))
    rows = rows.join(main, "token").join(own.join(prefixes.select("cls", "second"), "cls"), "cls").withColumn("step", F.floor(F.log("n") / F.log(F.lit(4 / 3))))
    rows = written(rows)
    settled(rows)
    minor = rows.where("comp <> main").withColumn("step", F.explode(F.expr("array(step - 1, step, step + 1)"))).alias("r")
    others = rows.alias("s")
    keys = [F.col(f"r.{k}") == F.col(f"s.{k}") for k in ("token", "step")]
    once = "arrays_overlap(r.second, s.second) and array_intersect(r.tokens, s.tokens)[0] = r.token"
    met = minor.join(others, [*keys, F.expr(f"r.comp <> s.comp and {_room('r', 's')} and {once}")])
    return met.select(F.least("r.cls", "s.cls").alias("x"), F.greatest("r.cls", "s.cls").alias("y")).distinct()


def _linked(a: np.ndarray, b: np.ndarray) -> bool:
    return 7 * len(np.intersect1d(a, b, assume_unique=True)) >= 3 * (len(a) + len(b))


def _met_in_all(pairs: DataFrame, prefixes: DataFrame) -> DataFrame:
    """The pairs that share a token of the second and of the third prefix."""
    side = lambda x: prefixes.select(F.col("cls").alias(x), F.col("second").alias(f"{x}2"), F.col("third").alias(f"{x}3"))
    return pairs.join(side("x"), "x").join(side("y"), "y").where(F.arrays_overlap("x2", "y2") & F.arrays_overlap("x3", "y3")).select("x", "y")


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b: the pairs whose similarity is at least 3/4."""
    whole = sets.select("cls", F.concat("cold", "hot").alias("s"))
    both = pairs.join(whole.select(F.col("cls").alias("x"), F.col("s").alias("sx")), "x")
    both = both.join(whole.select(F.col("cls").alias("y"), F.col("s").alias("sy")), "y").select("x", "y", "sx", "sy")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for name in ("sx", "sy"):
                col = batch.column(name)
                ends, flat = col.offsets.to_numpy(), col.values.to_numpy(zero_copy_only=False)
                sides.append([np.sort(flat[a:b]) for a, b in zip(ends[:-1], ends[1:])])
            keep = pa.array([_linked(a, b) for a, b in zip(*sides)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("x").filter(keep), batch.column("y").filter(keep)], ["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id: one row for each document.

    A-Z count as a-z; words lie between ASCII white space; a text's set holds its distinct five-word
    shingles, or its whole word sequence where it has fewer words. Two documents are linked when the
    intersection is at least 3/4 of the union; component_id is the least id that links reach, the
    document's own included. A text without words, null ones too, has an empty set, no links and its own
    id. Null ids take part in links and are never the least unless all are null. Repeated rows are kept;
    an empty table gives no rows; other columns are not read. Shingles are identified within a pair of sets by
    64-bit hashes, sets by 128 bits.
    """
    docs = documents(df, id_col, text_col).withColumn("sum", F.xxhash64("text"))
    hot = df.sparkSession.sparkContext.broadcast(hot_tokens(docs))
    hashed = written(_classes(docs, hot))
    classes = _told_apart(hashed)
    members = written(classes.select("doc_id", "sum", "cls", "more", "n"))
    least = F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "sum", "more")).alias("rep")
    reps = members.where("n > 0").groupBy("cls").agg(least)
    left = written(_survivors(classes).join(reps, "cls").select("cls", F.col("rep.more").alias("more"), "rep"))
    dropped(hashed)
    sets = written(_whole_sets(docs, left, hot))
    prefixes = written(_prefixes(sets, hot))
    settled(prefixes)
    rows = prefixes.select("cls", "n", "u", F.explode(F.arrays_zip("tokens", "places")).alias("t"))
    rows = written(rows.select(F.col("t.tokens").alias("token"), "cls", "n", F.col("t.places").alias("i"), "u"))
    links = None
    comps = None
    for round_ in range(STAR_ROUNDS + 1):
        now = rows.withColumn("comp", F.col("cls"))
        if comps is not None:
            now = rows.join(comps, rows["cls"] == comps["node"], "left").select("token", "cls", "n", "i", "u", F.coalesce("root", "cls").alias("comp"))
        now = written(now)
        pivots = written(_contested(now, round_))
        pairs = _open_pairs(now, pivots, prefixes) if round_ == STAR_ROUNDS else _star_pairs(now, pivots)
        fresh = written(_links(_met_in_all(pairs, prefixes), sets))
        dropped(now, pivots)
        links = fresh if links is None else links.unionByName(fresh)
        comps = components(links)
    ids = reps.select("cls", F.col("rep.doc_id").alias("rep"))
    roots = comps.join(ids, comps["node"] == ids["cls"]).groupBy("root").agg(F.min("rep").alias("component"))
    named = ids.join(comps, ids["cls"] == comps["node"], "left").join(roots, "root", "left")
    named = written(named.select("cls", F.coalesce("component", "rep").alias("component")))
    dropped(sets, rows, prefixes)
    return members.join(named, "cls", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component")).alias("component_id")
    )
