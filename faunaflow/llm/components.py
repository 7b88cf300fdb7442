"""Connected components of a distributed edge list, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faunaflow.llm.common import dropped, written


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours are tied to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # dealt out anew, so that the join below reads two shuffles and Spark may split the edges of a hub
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).repartition("a")
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node's smaller neighbours, and the node, are tied to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m")).repartition("a")
    kept = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return kept.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: every node of the edges (a, b) with the least node that it is connected with.

    Needs a number of rounds in the order of the logarithm of the longest path; each is written, and
    only a count and a checksum come to the driver.
    """
    now = written(edges.where("a <> b").distinct())
    seen = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if mark == seen:
            break
        seen, before = mark, now
        now = written(_small_star(_large_star(now)))
        dropped(before)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
