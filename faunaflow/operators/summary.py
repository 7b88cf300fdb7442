"""Summaries by group: all metrics of a table in one aggregation."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faunaflow.functions.stages import written
from faunaflow.operators.columns import convert_unit, half_even

CAP_AREA = 64 * 0.5  # times sin(2 pi / 64) r^2: round ends drawn with 64 corners


@dataclass(frozen=True)
class Metric:
    """name, statistic (sum, count, min, max, mean, nunique, median, unique, ratio, area), column, and how to show it."""

    name: str
    statistic: str
    column: str | None = None
    by: str | None = None
    scale: float = 1.0
    units: tuple[str, str] | None = None
    decimals: int | None = None
    order: str | None = None


def swath_area(dist: Column, width: float) -> Column:
    """Square metres within half a width of a segment."""
    import math

    return dist * width + F.lit(CAP_AREA * math.sin(2 * math.pi / 64) * (width / 2) ** 2)


def expression(m: Metric) -> Column:
    c = m.column
    if m.statistic == "ratio":
        found = F.try_divide(F.sum(m.column), F.sum(m.by)) * m.scale
    elif m.statistic == "area":
        found = F.coalesce(F.sum(swath_area(F.col(c), m.scale)), F.lit(0.0)) / 1e6
    else:
        found = {
            "sum": lambda: F.coalesce(F.sum(c), F.lit(0)), "count": lambda: F.count(c or F.lit(1)), "min": lambda: F.min(c), "max": lambda: F.max(c),
            "mean": lambda: F.avg(c), "nunique": lambda: F.countDistinct(c), "median": lambda: F.median(c),
        }[m.statistic]()
    if m.units:
        found = convert_unit(found, *m.units)
    return (half_even(found, m.decimals) if m.decimals is not None else found).alias(m.name)


def _unique(df: DataFrame, m: Metric, by: list[str]) -> DataFrame:
    """A group's distinct values in order of first appearance, in one text: the first place of each value comes first."""
    firsts = df.groupBy(*by, F.col(m.column).cast("string").alias("_value")).agg(F.min(m.order).alias("_first"))
    listed = F.sort_array(F.collect_list(F.struct("_first", "_value")))
    return firsts.groupBy(*by).agg(F.array_join(F.transform(listed, lambda x: x["_value"]), ", ").alias(m.name))


def summarize(df: DataFrame, metrics: list[Metric], by: list[str] = ()) -> DataFrame:
    """One row for each group of non-null keys, or for all; one column for each metric."""
    by = list(by)
    if by:
        df = df.dropna(subset=by)
    plain = [expression(m) for m in metrics if m.statistic != "unique"] or [F.count(F.lit(1)).alias("_rows")]
    found = df.groupBy(*by).agg(*plain)
    for m in metrics:
        if m.statistic == "unique":
            each = _unique(df, m, by)
            found = found.join(each, by, "left") if by else found.crossJoin(each)
    return found.select(*by, *[m.name for m in metrics])


def patrol_metrics() -> list[Metric]:
    """Effort of patrols: their number, days, distance, time and the ground they covered."""
    return [
        Metric("no_of_patrols", "nunique", "patrol_id"),
        Metric("patrol_days", "nunique", "segment_start_date"),
        Metric("distance_km", "sum", "dist_meters", units=("m", "km"), decimals=2),
        Metric("duration_h", "sum", "timespan_seconds", units=("s", "h"), decimals=2),
        Metric("area_km2", "area", "dist_meters", scale=500.0, decimals=2),
    ]


def encounter_rates(segments: DataFrame, events: DataFrame, by: list[str]) -> DataFrame:
    """Events against effort, over both tables together: counts, and rates by hour, km, patrol and patrol day."""
    both = segments.unionByName(events, allowMissingColumns=True).dropna(subset=by)
    got = both.groupBy(*by).agg(
        F.count("event_type").alias("encounters"),
        (F.sum("timespan_seconds") / 3600).alias("hours"),
        (F.sum("dist_meters") / 1000).alias("km"),
        F.countDistinct("patrol_id").alias("patrols"),
        F.countDistinct("patrol_id", "segment_start_date").alias("patrol_days"),
    )
    rates = {f"per_{n}": F.try_divide("encounters", c) for n, c in {"hour": "hours", "km": "km", "patrol": "patrols", "patrol_day": "patrol_days"}.items()}
    return got.withColumns(rates)


def complete_grid(df: DataFrame, bucket: str, category: str, values: list[str]) -> DataFrame:
    """Counts with a row for every bucket and value, 0 where there is none."""
    wide = df.groupBy(bucket).pivot(category, values).agg(F.count(F.lit(1))).na.fill(0)
    return wide.unpivot([bucket], values, category, "n")


def time_buckets(df: DataFrame, time: str, interval: str, by: list[str], metrics: list[Metric]) -> DataFrame:
    """Metrics by time interval (weeks begin on Monday) and category; rows without a time are dropped."""
    return summarize(df.where(F.col(time).isNotNull()).withColumn("bucket", F.date_trunc(interval, time).cast("timestamp_ntz")), metrics, ["bucket", *by])


def week_of_month(time: str) -> Column:
    """Weeks since the month's first day, from 1."""
    return F.floor(F.datediff(time, F.date_trunc("month", time)) / 7) + 1


def coverage_cells(df: DataFrame, width: float, cell: float) -> DataFrame:
    """Distinct square cells whose centre lies within half a width of a segment (planar x1, y1, x2, y2 in metres).

    Their number times the cell's area approximates the merged ground cover; the error is in proportion to the cell.
    """
    r = width / 2
    low = lambda a, b: F.floor((F.least(a, b) - r) / cell)
    high = lambda a, b: F.floor((F.greatest(a, b) + r) / cell)
    cells = df.select("*", F.explode(F.sequence(low("x1", "x2"), high("x1", "x2"))).alias("ix")).select("*", F.explode(F.sequence(low("y1", "y2"), high("y1", "y2"))).alias("iy"))
    px, py = (F.col("ix") + 0.5) * cell - F.col("x1"), (F.col("iy") + 0.5) * cell - F.col("y1")
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(px * dx + py * dy, dx * dx + dy * dy), F.lit(0.0))))
    return cells.where(F.hypot(px - t * dx, py - t * dy) <= r).select("ix", "iy").distinct()


def _islands(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, l, r: the union of intervals, as intervals that do not meet."""
    along = Window.partitionBy(*by).orderBy("l", "r")
    before = F.max("r").over(along.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("fresh", F.coalesce(F.col("l") > before, F.lit(True)).cast("int")).withColumn("island", F.sum("fresh").over(along))
    return marked.groupBy(*by, "island").agg(F.min("l").alias("l"), F.max("r").alias("r")).drop("island")


#: Intervals that a task lays out at once, islands that it holds before it passes them on, segments of one place that stay together.
LAID_OUT, HELD, CROWD = 1 << 18, 1 << 19, 10_000


def _united(line: np.ndarray, l: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The union of the intervals of each line, as intervals that do not meet."""
    if not len(line):
        return line, l, r
    order = np.lexsort((l, line))
    line, l, r = line[order], l[order], r[order]
    new = np.r_[True, line[1:] != line[:-1]]
    # the furthest end so far on the same line, by ranks that rise from line to line
    rank = np.empty(len(r), np.int64)
    rank[np.lexsort((r, line))] = np.arange(len(r))
    ends = np.empty(len(r))
    ends[rank] = r
    far = np.maximum.accumulate(rank)
    fresh = np.flatnonzero(new | np.r_[True, l[1:] > ends[far[:-1]]])
    return line[fresh], l[fresh], ends[far[np.r_[fresh[1:], len(r)] - 1]]


def _intervals(x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray, radius: float, height: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """line, l, r: where each line meets the ground within the radius of each segment, some LAID_OUT intervals at a time."""
    first = np.ceil((np.minimum(y1, y2) - radius) / height - 0.5).astype(np.int64)
    count = np.floor((np.maximum(y1, y2) + radius) / height - 0.5).astype(np.int64) - first + 1
    count[count < 0] = 0
    total = np.cumsum(count)
    for low in range(0, int(total[-1]) if len(total) else 0, LAID_OUT):
        n = np.arange(low, min(low + LAID_OUT, int(total[-1])))
        at = np.searchsorted(total, n, side="right")
        line = first[at] + n - (total[at] - count[at])
        ax, ay, bx, by, y = x1[at], y1[at], x2[at], y2[at], (line + 0.5) * height
        l, r, length = np.full(len(n), np.inf), np.full(len(n), -np.inf), np.hypot(bx - ax, by - ay)
        with np.errstate(divide="ignore", invalid="ignore"):
            # the circles about both ends, and the straight sides to the left and right
            for x, rest in ((ax, radius * radius - (y - ay) ** 2), (bx, radius * radius - (y - by) ** 2)):
                half = np.sqrt(rest)
                l, r = np.fmin(l, x - half), np.fmax(r, x + half)
            for sign in (1, -1):
                nx, ny = -(by - ay) * sign * radius / length, (bx - ax) * sign * radius / length
                share = (y - ay - ny) / (by - ay)
                x = np.where((share >= 0) & (share <= 1) & (length > 0), ax + nx + share * (bx - ax), np.nan)
                l, r = np.fmin(l, x), np.fmax(r, x)
        keep = l < r
        yield line[keep], l[keep], r[keep]


def coverage_area(df: DataFrame, swath: float, by: list[str] = (), strips: int = 32, salts: int = 16, tasks: int | None = None) -> DataFrame:
    """by, area_km2: the ground that lies within half a swath of any segment (planar x1, y1, x2, y2 in metres), overlaps once.

    A segment's ground is convex, so it meets each of the parallel lines, ``strips`` to a swath, in one interval, which follows from
    the row itself. The union of the intervals of a line is exact; between lines the area of a circle is off by about 0.5 / strips^1.5
    of it, longer ground by less. Segments meet by the tile that they start in, crowded tiles in up to ``salts`` groups; a task lays their
    intervals out a part at a time and passes on only islands, so neither a crowded place nor a long segment is held whole, and
    intervals are not shuffled.
    Islands are cut at tiles and merged along each line. Segments are narrow, so they are dealt out over ``tasks`` (four for each
    shuffle partition, if not given) whatever their size in bytes. Without segments the area is 0.
    """
    by, radius, height, tile = list(by), swath / 2, swath / strips, 64 * swath
    ends = ["x1", "y1", "x2", "y2"]
    rows = df.where(" and ".join(f"{c} is not null and not isnan({c})" for c in ends)).select(*by, *ends)
    rows = written(rows.withColumn("spot", F.xxhash64(*by, F.floor(F.col("x1") / tile), F.floor(F.col("y1") / tile))))
    crowded = rows.groupBy("spot").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CROWD)
    crowded = crowded.select("spot", F.least(F.lit(salts), F.ceil(F.col("n") / CROWD)).alias("groups"))
    group = F.pmod(F.xxhash64(*ends), F.coalesce("groups", F.lit(1)))
    rows = rows.join(F.broadcast(crowded), "spot", "left").withColumn("spot", F.xxhash64("spot", group))
    tasks = tasks or 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(tasks, "spot").sortWithinPartitions(*by, "spot").select(*by, *ends)

    def islands(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key, waiting = None, None, []

        def flush() -> pa.RecordBatch:
            size = len(held[0])
            keys = [pa.array([k.as_py()], k.type) for k in key]
            return pa.RecordBatch.from_arrays([*[k.take(pa.array(np.zeros(size, np.int64))) for k in keys], *map(pa.array, held)], names=[*by, "line", "l", "r"])

        for batch in parts:
            if not batch.num_rows:
                continue
            xs = [batch.column(c).to_numpy(zero_copy_only=False) for c in ends]
            cut = np.zeros(batch.num_rows, bool)
            cut[0] = True
            for c in by:
                code = pc.dictionary_encode(batch.column(c), null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                cut[1:] |= code[1:] != code[:-1]
            starts = np.flatnonzero(cut)
            for i, j in zip(starts, [*starts[1:], batch.num_rows]):
                now = [batch.column(c)[int(i)] for c in by]
                if held is not None and [k.as_py() for k in now] != [k.as_py() for k in key]:
                    yield flush()
                    held = None
                key = now
                for found in _intervals(*[x[i:j] for x in xs], radius, height):
                    held = _united(*(found if held is None else map(np.concatenate, zip(held, found))))
                    if len(held[0]) > HELD:
                        yield flush()
                        held = None
        if held is not None:
            yield flush()

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)
    rows = rows.mapInArrow(islands, f"{kinds + ', ' if by else ''}line long, l double, r double")
    rows = rows.withColumn("tile", F.explode(F.sequence(F.floor(F.col("l") / tile), F.floor(F.col("r") / tile))))
    rows = rows.withColumns({"l": F.greatest("l", F.col("tile") * tile), "r": F.least("r", (F.col("tile") + 1) * tile)})
    merged = _islands(rows, [*by, "line", "tile"])
    return merged.groupBy(*by).agg((F.coalesce(F.sum(F.col("r") - F.col("l")), F.lit(0.0)) * height / 1e6).alias("area_km2"))
