"""As-of lookups: rows meet the entries of a table around their own time, by the number of earlier entries as an equi key.

The distinct times of rows and table are numbered in order: sums within a bucket by a window over the bucket, and in front of it the
sums of earlier buckets, carried up and down a tree of BRANCH children a node, so that no window spans the table. Each entry then
goes to the few places between entries from which it can be seen, and a row meets the line of its own place. A line holds no more
entries than were asked for, however many share a bucket or a time. Neither side is broadcast unless Spark finds it small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faunaflow.functions.stages import written
from faunaflow.functions.times import MINUTE, micros

#: Children of a node of the tree and its levels: 2^42 buckets, of a day or of a microsecond.
BRANCH_BITS, LEVELS = 14, 3


def sums_before(buckets: DataFrame, key: str, value: str) -> DataFrame:
    """key and before: the sum of ``value`` over all lesser keys. Keys are distinct, between -2^41 and 2^41.

    A window holds the children of one node of the tree at most.
    """
    shift = 1 << (BRANCH_BITS * LEVELS - 1)
    node = lambda k: F.shiftrightunsigned(F.col(key) + F.lit(shift), BRANCH_BITS * k).alias(f"n{k}")
    rows = buckets.select(key, F.col(value).alias("amount"), *[node(k) for k in range(LEVELS + 1)])
    out = rows.select(key, "n1", "n2", "n3", (F.sum("amount").over(Window.partitionBy("n1").orderBy("n0")) - F.col("amount")).alias("b0"))
    for k in range(1, LEVELS):
        above = [f"n{i}" for i in range(k, LEVELS + 1)]
        sums = rows.groupBy(*above).agg(F.sum("amount").alias("s"))
        before = F.sum("s").over(Window.partitionBy(f"n{k + 1}").orderBy(f"n{k}")) - F.col("s")
        out = out.join(sums.select(f"n{k}", before.alias(f"b{k}")), f"n{k}")
    return out.select(key, sum(F.col(f"b{k}") for k in range(LEVELS)).alias("before"))


def bucket_of(time: str, width: int) -> Column:
    """The bucket of a time, of that many microseconds."""
    return F.floor(micros(time) / width)


def _nearest_of_a_time(entries: DataFrame, before: int, after: int) -> DataFrame:
    """img_id, img_time, first, last: of each time the first ``after`` and the last ``before`` entries, with their ranks from either end.

    Others are hidden from every place by entries of their own time. Ranks in order and from the end are limited apart, so
    that a time that many entries share is cut down before it is shuffled.
    """
    by = Window.partitionBy("img_time")
    head = entries.withColumn("first", F.row_number().over(by.orderBy("img_id"))).where(F.col("first") <= after).withColumn("last", F.lit(None).cast("int"))
    tail = entries.withColumn("last", F.row_number().over(by.orderBy(F.desc("img_id")))).where(F.col("last") <= before).withColumn("first", F.lit(None).cast("int"))
    return head.unionByName(tail)


def lines(df: DataFrame, time: str, table: DataFrame, before: int, after: int, bucket_us: int = MINUTE, strict: bool = False) -> DataFrame:
    """df with line: the last ``before`` entries (img_time, img_id) at or before its time and the first ``after`` ones later, in order.

    With strict, entries of a row's very time count as later. Entries of one time are in the order of their ids; null times have no
    line, rows without any entry an empty one. Buckets only deal out the numbering of distinct times: of a minute's length they hold
    60 million of them at most.
    """
    entries = table.where("img_time is not null").select("img_id", "img_time")
    moments = entries.groupBy(F.col("img_time").alias("asof_moment")).agg(F.count(F.lit(1)).alias("n"))
    moments = moments.unionByName(df.where(F.col(time).isNotNull()).select(F.col(time).alias("asof_moment")).distinct().withColumn("n", F.lit(0).cast("long")))
    moments = written(moments.groupBy("asof_moment").agg(F.sum("n").alias("n")).withColumn("bucket", bucket_of("asof_moment", bucket_us)))
    counts = moments.groupBy("bucket").agg(F.sum("n").alias("amount"))
    within = F.sum("n").over(Window.partitionBy("bucket").orderBy("asof_moment")) - F.col("n")
    places = moments.withColumn("within", within).join(sums_before(counts, "bucket", "amount"), "bucket")
    places = written(places.select("asof_moment", "n", (F.col("before") + F.col("within")).alias("below")))
    # entry k lies in the lines of the places that have k - after to k + before - 1 entries below them
    ranked = _nearest_of_a_time(entries, before, after).join(places.withColumnRenamed("asof_moment", "img_time"), "img_time")
    ranked = ranked.withColumn("k", F.col("below") + F.coalesce(F.col("first"), F.col("n") - F.col("last") + 1))
    seen = ranked.select("k", "img_time", "img_id", F.explode(F.sequence(F.greatest(F.col("k") - after, F.lit(0)), F.col("k") + before - 1)).alias("place"))
    seen = seen.where((F.col("place") <= F.col("below")) | (F.col("place") >= F.col("below") + F.col("n")))
    found = seen.groupBy("place").agg(F.array_sort(F.collect_set(F.struct("k", "img_time", "img_id"))).alias("numbered"))
    found = found.select("place", F.transform("numbered", lambda i: F.struct(i["img_time"].alias("img_time"), i["img_id"].alias("img_id"))).alias("line"))
    empty = F.array().cast(found.schema["line"].dataType)
    asked = places.select("asof_moment", (F.col("below") if strict else F.col("below") + F.col("n")).alias("place"))
    asked = asked.join(found, "place", "left").select("asof_moment", F.coalesce("line", empty).alias("line"))
    return df.join(asked, F.col(time) == F.col("asof_moment"), "left").select(*df.columns, "line")
