"""Document fingerprints: a homomorphic multiset hash, in DataFrame functions alone.

Every paragraph (line) hashes to a wide vector; a text's fingerprint is the lane-by-lane sum of its
paragraphs' vectors, each lane modulo 2^32. The order of paragraphs does not matter, and adding or
removing a paragraph adds or subtracts its vector (:func:`combine`). A paragraph's vector has

* 8 lanes from four 64-bit hashes of the whole paragraph: they decide equality;
* 1 lane with its number of word pairs, and 64 lanes that count set bits over the hashes of those
  pairs: centred, they are a random projection of the multiset of word pairs, so the angle between
  two sums estimates how much two texts share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faunaflow.llm.common import documents, settled, sha256, written

WHOLE, BITS = 4, 32
LANE = 0xFFFFFFFF
#: Rows without an id are dealt out over so many keys.
SPREAD = 4096


def _whole(i: int) -> str:
    return f"if(first, xxhash64({i}, par), 0L)"


def fingerprint(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, ``lanes`` (array of 73 longs below 2^32): one row for each value of keys.

    A text without line breaks is one paragraph; so is an empty or null one.
    """
    pars = df.select(*keys, F.explode(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).alias("par"))
    words = pars.select(*keys, "par", F.split("par", " ", -1).alias("w"))
    pairs = words.select(*keys, "par", F.posexplode(F.expr("arrays_zip(w, slice(w, 2, size(w)))")).alias("at", "pair"))
    hashed = pairs.select(
        *keys, "par", (F.col("at") == 0).alias("first"), F.xxhash64(F.col("pair").getField("w"), F.col("pair").getField("1")).alias("h")
    )
    sums = [F.sum(F.expr(f"{_whole(i)} & {LANE}L")).alias(f"a{2 * i}") for i in range(WHOLE)]
    sums += [F.sum(F.expr(f"shiftrightunsigned({_whole(i)}, 32)")).alias(f"a{2 * i + 1}") for i in range(WHOLE)]
    # two counters of 32 bits share a long
    sums += [F.sum(F.expr(f"(shiftrightunsigned(h, {j}) & 1L) | shiftleft(shiftrightunsigned(h, {j + 32}) & 1L, 32)")).alias(f"b{j}") for j in range(BITS)]
    got = hashed.groupBy(*keys).agg(F.count(F.lit(1)).alias("m"), *sums)
    lanes = [F.expr(f"a{i} & {LANE}L") for i in range(2 * WHOLE)] + [F.expr(f"m & {LANE}L")]
    lanes += [F.expr(f"b{j} & {LANE}L") for j in range(BITS)] + [F.expr(f"shiftrightunsigned(b{j}, 32)") for j in range(BITS)]
    return got.select(*keys, F.array(*lanes).alias("lanes"))


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """The fingerprint with b's paragraphs inserted into a's (sign 1) or deleted from them (-1)."""
    return F.zip_with(a, b, lambda x, y: F.pmod(x + sign * y, F.lit(LANE + 1)))


def as_text(lanes: Column) -> Column:
    return F.array_join(F.transform(lanes, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: the cosine of the centred lanes, below 0 as 0; equal fingerprints have exactly 1."""
    at = 2 * WHOLE + 1
    dot = lambda x, y: F.aggregate(
        F.zip_with(F.slice(x, at + 1, 2 * BITS), F.slice(y, at + 1, 2 * BITS), lambda p, q: (2 * p - x[at - 1]).cast("double") * (2 * q - y[at - 1])),
        F.lit(0.0),
        lambda s, v: s + v,
    )
    size = F.sqrt(dot(a, a) * dot(b, b))
    cos = F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))
    return F.when(a == b, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), cos)))


def ring(ids: DataFrame) -> DataFrame:
    """doc_id, next_id: each distinct id with the next smaller one; the smallest with the largest.

    Range partitions order the ids; only the first id of each partition, one row a partition, is
    compared across partitions.
    """
    dealt = written(ids.where("doc_id is not null").distinct().repartitionByRange(F.col("doc_id").desc()).select("doc_id", F.spark_partition_id().alias("part")))
    heads = dealt.groupBy("part").agg(F.max("doc_id").alias("head"))
    along = Window.orderBy("part")
    heads = heads.select("part", F.coalesce(F.lead("head").over(along), F.first("head").over(along)).alias("after"))
    within = Window.partitionBy("part").orderBy(F.col("doc_id").desc())
    rows = dealt.select("doc_id", "part", F.lead("doc_id").over(within).alias("next_id"))
    return rows.join(F.broadcast(heads), "part").select("doc_id", F.coalesce("next_id", "after").alias("next_id"))


def edited_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are.

    Edited: the last floor(n_chars / 2) code points are replaced by the first as many of the next
    document's text, in descending id, the first after the last. Returns doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. Null text is empty. Where
    ids repeat, every row is returned, and "the next document" is the least text of the next id. A row
    with a null id has an empty next document. An empty table gives no rows; other columns are not read.
    """
    # rows without an id have a spread above 0. Both readers of the join below share one shuffle of the texts, and the rows stay where it
    # brought them: keys can be seen never to be null and are no literals, so that no filter or fewer keys set the readers apart
    spread = F.coalesce(F.when(F.isnull("doc_id"), F.pmod(F.xxhash64("text"), F.lit(SPREAD)) + 1).otherwise(F.lit(0).cast("long")), F.lit(0).cast("long"))
    zero = lambda key: F.coalesce(F.pmod(F.col(key), F.lit(1).cast("long")), F.lit(0).cast("long")).alias("spread")
    docs = documents(df, id_col, text_col).select("text", F.coalesce("doc_id", F.lit(0).cast("long")).alias("key"), spread.alias("spread"))
    real = F.when(F.col("spread") == 0, F.col("key")).alias("doc_id")
    order = ring(docs.select(real))
    lengths = docs.groupBy(real).agg(F.max(F.length("text")).alias("n"))
    asks = order.join(lengths, "doc_id").select(F.col("next_id").alias("of"), F.col("doc_id").alias("by"), F.expr("cast(n div 2 as int)").alias("need"))
    asks = order.join(asks, order["doc_id"] == asks["of"]).select(F.coalesce(order["doc_id"], F.lit(0).cast("long")).alias("key"), "next_id", "by", "need")
    asks = asks.select("key", zero("key"), "next_id", "by", "need")
    found = docs.join(asks, ["key", "spread"], "left")
    heads = found.where("by is not null").groupBy(F.col("by").alias("key"), zero("by")).agg(F.min(F.expr("left(text, need)")).alias("head"))
    own = found.select("key", "spread", real, "next_id", "text", F.length("text").alias("n")).join(heads, ["key", "spread"], "left")
    half = F.expr("cast(n div 2 as int)")
    # rows of one key are numbered by text: equal ones may change places, so a task that runs again does no harm
    same_key = Window.partitionBy("key", "spread").orderBy(F.xxhash64("text"))
    both = own.select(
        "key",
        "spread",
        "doc_id",
        "next_id",
        "n",
        F.row_number().over(same_key).alias("row"),
        F.col("text"),
        F.concat(F.expr("left(text, cast(n - n div 2 as int))"), F.coalesce(F.left(F.col("head"), half), F.lit(""))).alias("edited"),
    )
    each = both.select(
        "key", "spread", "doc_id", "next_id", "row", "n", sha256(F.col("edited")).alias("edited_sha256"), F.posexplode(F.array("text", "edited")).alias("kind", "body")
    )
    keys = ["key", "spread", "doc_id", "next_id", "row", "n", "edited_sha256"]
    prints = fingerprint(each, [*keys, "kind"], "body")
    lanes = prints.groupBy(*keys).agg(F.max(F.when(F.col("kind") == 0, F.col("lanes"))).alias("a"), F.max(F.when(F.col("kind") == 1, F.col("lanes"))).alias("b"))
    lanes = written(lanes)
    settled(df)
    least = lanes.where("doc_id is not null").groupBy(F.col("doc_id").alias("next_id")).agg(F.min("a").alias("c"))
    empty = F.array(*[F.lit(0).cast("long")] * (2 * WHOLE + 1 + 2 * BITS))
    joined = lanes.join(least, "next_id", "left")
    return joined.select(
        "doc_id",
        F.col("n").cast("long").alias("n_chars"),
        "edited_sha256",
        as_text(F.col("a")).alias("fingerprint"),
        as_text(F.col("b")).alias("edited_fingerprint"),
        likeness(F.col("a"), F.col("b")).alias("near_edited"),
        likeness(F.col("a"), F.coalesce(F.col("c"), empty)).alias("near_next"),
    )
