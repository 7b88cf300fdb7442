"""Near duplicates by SimHash: pigeonhole blocks, bounded groups, verified Hamming distances.

Two fingerprints that differ in at most d bits agree in all but d of any m blocks of their bits. So each fingerprint
is listed under the bits of every choice of m - d blocks, fingerprints that share such a key meet there, and
their distances are verified. Where a key has more than LIMIT fingerprints, its free bits are split into blocks
again and its fingerprints are listed under the longer keys: this loses no pair, as at most d of the new
blocks differ either. After three such splits at most 5 of 64 bits are free, so no group exceeds 32 fingerprints,
whatever the table holds: groups stay small without a cap, and no key is too hot for a task.

Equal fingerprints are one node, so exact copies cost a count. A group gives one edge for each fingerprint that is
linked within it, to the least of those it reaches there, never all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faunaflow.llm.common import documents, written
from faunaflow.llm.components import components

#: Words in a shingle, the seed of its hash, bits in which linked fingerprints may differ.
WORDS, SEED, DISTANCE = 3, 42, 2
BLOCKS = 5
#: Fingerprints that one task compares with each other.
LIMIT = 256
#: Shingles hashed at once; bounds memory, not results.
CHUNK = 50_000


def fingerprint(text: bytes) -> int:
    """64 bits: a bit is set where more than half of the shingles' hashes, repeats included, have it set."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    k = min(WORDS, len(words))
    shingles, n, counts = map(b" ".join, zip(*(words[i:] for i in range(k)))), len(words) - k + 1, np.zeros(64, np.int64)
    for size in [CHUNK] * (n // CHUNK) + [n % CHUNK]:
        h = np.fromiter((xxh64_intdigest(s, SEED) for s in islice(shingles, size)), "<u8", size)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp: the fingerprint of every text, as a signed integer."""
    schema = docs.select("doc_id").schema.add("fp", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t.as_py()) for t in batch.column("text")], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64))], schema.names)

    return docs.withColumn("text", F.col("text").cast("binary")).mapInArrow(run, schema)


def longer_masks(mask: int, blocks: int = BLOCKS, distance: int = DISTANCE) -> list[int]:
    """The mask with every choice of all but ``distance`` of so many blocks of its free bits added, as signed integers.

    With no more free bits than blocks the mask is returned as it is: its groups cannot be split so.
    """
    free = [i for i in range(64) if not mask >> i & 1]
    if len(free) <= blocks:
        return [_signed(mask)]
    parts = [sum(1 << int(i) for i in part) for part in np.array_split(free, blocks)]
    return [_signed(mask | sum(chosen)) for chosen in combinations(parts, blocks - distance)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 & 1 else x


def _edges(groups: DataFrame, distance: int) -> DataFrame:
    """a, b: each fingerprint of a group with the least one that it reaches within the group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for fps in batch.column(0):
                x = np.sort(fps.values.to_numpy())
                near = np.bitwise_count((x[:, None] ^ x[None, :]).view(np.uint64)) <= distance
                root = np.arange(len(x))
                while True:
                    least = np.where(near, root[None, :], len(x)).min(axis=1)
                    if (least == root).all():
                        break
                    root = least
                out.append(np.stack([x, x[root]])[:, root != np.arange(len(x))])
            a, b = np.concatenate(out, axis=1) if out else np.empty((2, 0), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return groups.mapInArrow(run, "a long, b long")


def near_edges(fps: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, limit: int = LIMIT) -> DataFrame:
    """a, b: edges among the distinct fingerprints ``fp`` that connect just those whom links connect.

    ``limit`` is the size at which a group is split further; it decides no result.
    """
    spark = fps.sparkSession
    masks = longer_masks(0, blocks, distance)
    keyed = fps.select("fp", F.explode(F.array(*map(F.lit, masks))).alias("mask"))
    found = []
    while masks:
        keyed = keyed.withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
        sizes = written(keyed.groupBy("mask", "value").agg(F.count(F.lit(1)).alias("c")).where("c > 1"))
        next_ = {m: longer_masks(m & (1 << 64) - 1, blocks, distance) for m in masks}
        final = [m for m in masks if next_[m] == [m]]
        whole = (F.col("c") <= limit) | F.col("mask").isin(final) if final else F.col("c") <= limit
        met = keyed.join(sizes, ["mask", "value"])
        found.append(written(_edges(met.where(whole).groupBy("mask", "value").agg(F.collect_list("fp").alias("fps")).select("fps"), distance).distinct()))
        if sizes.where(~whole).isEmpty():
            break
        # a table of fixed size: the masks that follow each mask of this level
        table = spark.createDataFrame([(m, x) for m in masks if m not in final for x in next_[m]], "mask long, longer long")
        crowded = met.where(~whole).join(F.broadcast(table), "mask")
        keyed = written(crowded.select("fp", F.col("longer").alias("mask")).distinct())
        masks = sorted({x for m in masks if m not in final for x in next_[m]})
    edges = found[0]
    for more in found[1:]:
        edges = edges.unionByName(more)
    return edges


def simhash_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, blocks: int = BLOCKS, limit: int = LIMIT) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: one row for each document.

    A-Z count as a-z; words lie between ASCII white space; a text of fewer than three words is one shingle, and one without words, null
    included, has the fingerprint zero, which links like any other. Fingerprints are linked where at most ``distance`` bits differ, and
    component_id is the least id that links reach. Null ids take part and are never the least unless all are null.
    Repeated rows are kept; an empty table gives no rows; other columns are not read.
    """
    members = written(fingerprints(documents(df, id_col, text_col)))
    nodes = written(members.groupBy("fp").agg(F.min("doc_id").alias("least")))
    comps = components(near_edges(nodes.select("fp"), distance, blocks, limit))
    rooted = nodes.join(comps, nodes["fp"] == comps["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return members.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
