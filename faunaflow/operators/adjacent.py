"""Neighbours and running sums along long histories: chunks of time are ordered by themselves, small tables bridge them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _chunked(df: DataFrame, time: str, chunk: str) -> DataFrame:
    """df with adj_chunk, the start of the row's chunk of time; rows without a time come before all others."""
    return df.withColumn("adj_chunk", F.coalesce(F.date_trunc(chunk, time).cast("timestamp_ntz"), F.lit("0001-01-01").cast("timestamp_ntz")))


def _bridged(rows: DataFrame, bridges: DataFrame, key: str) -> DataFrame:
    """rows with the columns that their chunk has in bridges, one row for each key and chunk; null keys meet."""
    other = bridges.withColumnsRenamed({key: "adj_key", "adj_chunk": "adj_part"})
    return rows.join(other, F.col(key).eqNullSafe(F.col("adj_key")) & (F.col("adj_chunk") == F.col("adj_part"))).drop("adj_key", "adj_part")


def with_adjacent(
    df: DataFrame, key: str, time: str, tie: list[str] = (), after: list[str] = (), before: list[str] = (), first: list[str] = (), chunk: str = "month"
) -> DataFrame:
    """df with after, before, first: structs of the named columns of the next, the previous and the very first row of the same key.

    Rows are ordered by time, then ``tie``; only structs that were asked for are added, and after or before is null where no such
    row is. A task orders one key's rows of one chunk of time, never a whole history; at the ends of a chunk the neighbour comes from
    a table of one row for each key and chunk. Rows without a time are one chunk before all others. An empty table gives no rows.
    """
    rows, order = _chunked(df, time, chunk), F.struct(time, *tie)
    within = Window.partitionBy(key, "adj_chunk").orderBy(time, *tie)
    along = Window.partitionBy(key).orderBy("adj_chunk")
    kept, bridges, found = [], [], {}
    if after:
        kept.append(F.min_by(F.struct(*after), order).alias("adj_head"))
        bridges.append(F.lead("adj_head").over(along).alias("adj_after"))
        found["after"] = F.coalesce(F.lead(F.struct(*after)).over(within), F.col("adj_after"))
    if before:
        kept.append(F.max_by(F.struct(*before), order).alias("adj_tail"))
        bridges.append(F.lag("adj_tail").over(along).alias("adj_before"))
        found["before"] = F.coalesce(F.lag(F.struct(*before)).over(within), F.col("adj_before"))
    if first:
        kept.append(F.min_by(F.struct(*first), order).alias("adj_first"))
        bridges.append(F.first("adj_first").over(along).alias("first"))
    table = rows.groupBy(key, "adj_chunk").agg(*kept).select(key, "adj_chunk", *bridges)
    got = _bridged(rows, table, key).withColumns(found) if found else _bridged(rows, table, key)
    return got.select(*df.columns, *found, *(["first"] if first else []))


def running_sum(df: DataFrame, key: str, time: str, value: Column, out: str, tie: list[str] = (), chunk: str = "month") -> DataFrame:
    """df with out: the sum of value over the rows of the same key up to this one, in the order of time, then ``tie``.

    Null values add nothing, and before the first value the sum is null. Sums of whole chunks of time are carried forward, so no task
    holds a whole history.
    """
    rows = _chunked(df, time, chunk).withColumn("adj_value", value)
    along = Window.partitionBy(key).orderBy("adj_chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(key, "adj_chunk").agg(F.sum("adj_value").alias("adj_sum")).select(key, "adj_chunk", F.sum("adj_sum").over(along).alias("adj_base"))
    within = Window.partitionBy(key, "adj_chunk").orderBy(time, *tie).rowsBetween(Window.unboundedPreceding, 0)
    part, base = F.sum("adj_value").over(within), F.col("adj_base")
    total = F.when(part.isNull() & base.isNull(), None).otherwise(F.coalesce(part, F.lit(0.0)) + F.coalesce(base, F.lit(0.0)))
    return _bridged(rows, sums, key).withColumn(out, total).select(*[c for c in df.columns if c != out], out)
