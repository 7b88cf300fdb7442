"""Trajectories: straight segments between consecutive fixes of a subject, and work along them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faunaflow.functions.geodesy import with_geodesic
from faunaflow.functions.stages import written
from faunaflow.functions.times import DAY, at_micros, micros, seconds
from faunaflow.operators.adjacent import with_adjacent

SEGMENT = ["groupby_col", "segment_start", "segment_end", "timespan_seconds", "dist_meters", "speed_kmhr", "heading", "x1", "y1", "x2", "y2", "junk_status", "nsd"]


def from_fixes(df: DataFrame, tie: list[str] = (), chunk: str = "month") -> DataFrame:
    """One segment from each fix to the subject's next; extra columns and the flag come from its start.

    A subject of one fix has none. nsd is the squared distance of the segment's end from the subject's first fix, in km2.
    ``tie`` orders fixes of one time. A task sorts one subject's fixes of one chunk of time (:func:`faunaflow.operators.adjacent.with_adjacent`),
    so a long history does not meet in one task.
    """
    extra = [c for c in df.columns if c.startswith("extra__")]
    rows = df.where("groupby_col is not null and fixtime is not null")
    rows = with_adjacent(rows, "groupby_col", "fixtime", tie, after=["fixtime", "lon", "lat"], first=["lon", "lat"], chunk=chunk)
    rows = rows.where("after is not null").select(
        "groupby_col",
        F.col("fixtime").alias("segment_start"),
        F.col("after.fixtime").alias("segment_end"),
        F.col("lon").alias("x1"),
        F.col("lat").alias("y1"),
        F.col("after.lon").alias("x2"),
        F.col("after.lat").alias("y2"),
        F.col("first.lon").alias("x0"),
        F.col("first.lat").alias("y0"),
        "junk_status",
        *extra,
    )
    rows = with_geodesic(rows, "x1", "y1", "x2", "y2", "dist_meters", "heading")
    rows = with_geodesic(rows, "x0", "y0", "x2", "y2", "from_first")
    rows = rows.withColumn("timespan_seconds", seconds("segment_start", "segment_end"))
    return rows.withColumns(
        {"speed_kmhr": F.try_divide("dist_meters", "timespan_seconds") * 3.6, "nsd": (F.col("from_first") / 1000) ** 2}
    ).select(*SEGMENT, *extra)


def segment_filter(
    df: DataFrame, length: tuple = (0.001, 100000), time: tuple = (1, 172800), speed: tuple = (0.01, 500)
) -> DataFrame:
    """Marks segments outside any of the bounds, which are inclusive; missing values are inside."""
    out = F.lit(False)
    for c, (low, high) in {"dist_meters": length, "timespan_seconds": time, "speed_kmhr": speed}.items():
        if high <= low:
            raise ValueError(f"{c}: the upper bound must exceed the lower")
        out = out | F.coalesce(~F.isnan(c) & ((F.col(c) < low) | (F.col(c) > high)), F.lit(False))
    return df.withColumn("junk_status", F.col("junk_status").cast("boolean") | out)


def turn_angles(df: DataFrame) -> DataFrame:
    """df with turn_angle in [-180, 180), null where the segment before does not end at this one's start."""
    rows = with_adjacent(df, "groupby_col", "segment_start", before=["segment_end", "x2", "y2", "heading"])
    follows = (F.col("before.segment_end") == F.col("segment_start")) & (F.col("before.x2") == F.col("x1")) & (F.col("before.y2") == F.col("y1"))
    turn = F.pmod(F.col("heading") - F.col("before.heading") + 540, F.lit(360)) - 180
    return rows.withColumn("turn_angle", F.when(follows, turn)).drop("before")


def displacement(df: DataFrame) -> DataFrame:
    """groupby_col, displacement (metres from the first to the last point), tortuosity (path by displacement)."""
    ends = df.groupBy("groupby_col").agg(
        F.min_by(F.struct("x1", "y1"), "segment_start").alias("a"), F.max_by(F.struct("x2", "y2"), "segment_start").alias("b"), F.sum("dist_meters").alias("path")
    )
    ends = with_geodesic(ends.select("groupby_col", "path", "a.*", "b.*"), "x1", "y1", "x2", "y2", "displacement")
    return ends.select("groupby_col", "displacement", F.try_divide("path", "displacement").alias("tortuosity"))


def upsample(df: DataFrame, step_seconds: int) -> DataFrame:
    """groupby_col, fixtime, lon, lat at regular times from the subject's first start; none in gaps.

    Each segment lays out its own times: no range join. At a shared end the later segment's place wins.
    """
    us = step_seconds * 1_000_000
    rows = df.select("groupby_col", "segment_start", "x1", "y1", "x2", "y2", micros("segment_start").alias("s"), micros("segment_end").alias("e"))
    rows = with_adjacent(rows, "groupby_col", "segment_start", after=["s"], first=["s"]).withColumns({"after": F.col("after.s"), "zero": F.col("first.s")})
    rows = rows.withColumn("k0", F.expr(f"(s - zero + {us - 1}) div {us}")).withColumn(
        "k1", F.expr(f"case when after = e then (e - zero - 1) div {us} else (e - zero) div {us} end")
    )
    ticks = rows.where("k1 >= k0").withColumn("k", F.explode(F.sequence("k0", "k1"))).withColumn("t", F.expr(f"zero + k * {us}"))
    share = F.when(F.col("e") > F.col("s"), (F.col("t") - F.col("s")) / (F.col("e") - F.col("s"))).otherwise(0.0)
    return ticks.select(
        "groupby_col", at_micros("t").alias("fixtime"), (F.col("x1") + share * (F.col("x2") - F.col("x1"))).alias("lon"), (F.col("y1") + share * (F.col("y2") - F.col("y1"))).alias("lat")
    )


def to_fixes(df: DataFrame) -> DataFrame:
    """groupby_col, fixtime, lon, lat: all starts and ends, one for each time; a start wins over an end."""
    place = lambda t, x, y, k: F.struct(F.col(t).alias("fixtime"), F.lit(k).alias("k"), F.col(x).alias("lon"), F.col(y).alias("lat"))
    rows = df.select("groupby_col", F.explode(F.array(place("segment_start", "x1", "y1", 0), place("segment_end", "x2", "y2", 1))).alias("p")).select("groupby_col", "p.*")
    return rows.groupBy("groupby_col", "fixtime").agg(F.min_by(F.struct("lon", "lat"), "k").alias("p")).select("groupby_col", "fixtime", "p.lon", "p.lat")


#: One chunk of a walk, in microseconds.
CHUNK = 30 * DAY


def _next_fix(wanted: DataFrame, fixes: DataFrame, heads: DataFrame, chunk_us: int) -> DataFrame:
    """wanted (groupby_col, at) with next: the time of the subject's first fix at or after ``at``, null where none is.

    It lies in the chunk of ``at`` or at the head of the next chunk that has fixes.
    """
    chunk = F.floor(F.col("at") / chunk_us).alias("chunk")
    asked = wanted.select("groupby_col", "at").distinct().select("groupby_col", "at", chunk)
    rows = asked.select("groupby_col", "chunk", "at", F.lit(None).cast("long").alias("t")).unionByName(
        fixes.join(asked.select("groupby_col", "chunk").distinct(), ["groupby_col", "chunk"], "left_semi").select("groupby_col", "chunk", F.col("t").alias("at"), "t")
    )
    # from the last backwards, at one time a fix before the question
    w = Window.partitionBy("groupby_col", "chunk").orderBy(F.desc("at"), F.desc_nulls_last("t")).rowsBetween(Window.unboundedPreceding, 0)
    here = rows.withColumn("here", F.min("t").over(w)).where("t is null").select("groupby_col", "chunk", "at", "here")
    marks = heads.select("groupby_col", "chunk", "head").unionByName(asked.select("groupby_col", "chunk", F.lit(None).cast("long").alias("head")))
    marks = marks.groupBy("groupby_col", "chunk").agg(F.min("head").alias("head"))
    later = marks.withColumn("later", F.min("head").over(Window.partitionBy("groupby_col").orderBy("chunk").rowsBetween(1, Window.unboundedFollowing)))
    found = here.join(later.select("groupby_col", "chunk", "later"), ["groupby_col", "chunk"]).select("groupby_col", "at", F.coalesce("here", "later").alias("next"))
    return wanted.join(found, ["groupby_col", "at"])


def _in_groups(step: Callable[[pa.Table, np.ndarray], pa.Table]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For rows that stand in the order of groupby_col, chunk, t: step(table, starts) of many whole groups at a time, and where each begins.

    A group that goes on in the next batch is held back until it ends, so small groups share a call and none is cut.
    """

    def starts(table) -> np.ndarray:
        subject, chunk = (table.column(c).to_numpy(zero_copy_only=False) if isinstance(table, pa.RecordBatch) else table.column(c).to_numpy() for c in ("groupby_col", "chunk"))
        return np.r_[0, np.flatnonzero((subject[1:] != subject[:-1]) | (chunk[1:] != chunk[:-1])) + 1]

    def whole(parts: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
        table = pa.Table.from_batches(parts)
        return step(table, starts(table)).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = lambda batch: tuple(batch.column(c)[0].as_py() for c in ("groupby_col", "chunk"))
        for batch in batches:
            if not batch.num_rows:
                continue
            last = int(starts(batch)[-1])
            if held and last == 0 and key(batch) == key(held[0]):
                held.append(batch)
                continue
            if held or last:
                yield from whole([*held, batch.slice(0, last)])
            held = [batch.slice(last)]
        if held:
            yield from whole(held)

    return run


def _steps_ahead(t: np.ndarray, starts: np.ndarray, low: int, chunk_us: int) -> tuple[np.ndarray, np.ndarray]:
    """The place of each fix's next one, and the end of the fix's group; where the next one lies beyond the chunk its place is not before that end."""
    group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(t)]))
    # groups are laid one after the other on one line, too far apart for a step; a longer step than a chunk leaves it too
    low = min(low, chunk_us + 1)
    line = t - t[starts][group] + group * (chunk_us + low + 1)
    return np.searchsorted(line, line + low, side="left"), np.r_[starts[1:], len(t)][group]


def downsample(df: DataFrame, step_seconds: float, tolerance_seconds: float = 0, chunk_us: int = CHUNK) -> DataFrame:
    """Fixes chosen by a walk: the next one at least step - tolerance later; extra__burst changes where it is later than step + tolerance.

    A subject's last place is not returned; of fixes of one time the one with the least lon, lat counts. Subjects without a name and
    fixes without a time are left out.

    What a walk does in a chunk of time follows from where it enters. So each chunk finds, for every fix at which any walk may
    enter it, where the walk leaves and enters a later chunk, and how many bursts it begins meanwhile; the walk of a subject is
    the composition of these steps, doubled in each round, from its first fix. Then each chunk is walked from its one true
    entry. No task holds more than a chunk of one subject, and a history of n chunks needs about log2(n) rounds.
    """
    low, high = max(int((step_seconds - tolerance_seconds) * 1e6), 1), int((step_seconds + tolerance_seconds) * 1e6)
    fixes = df.where("groupby_col is not null and fixtime is not null").select("groupby_col", micros("fixtime").alias("t"), "lon", "lat")
    fixes = fixes.groupBy("groupby_col", "t").agg(F.min(F.struct("lon", "lat")).alias("at")).select("groupby_col", F.floor(F.col("t") / chunk_us).alias("chunk"), "t", "at.lon", "at.lat")
    fixes = written(fixes)
    heads = written(fixes.groupBy("groupby_col", "chunk").agg(F.min("t").alias("head"), F.max("t").alias("last")))
    leaves = fixes.select("groupby_col", "chunk", "t").join(heads, ["groupby_col", "chunk"]).where(F.col("t") + low > F.col("last"))
    leaves = _next_fix(leaves.select("groupby_col", "t", (F.col("t") + low).alias("at")), fixes, heads, chunk_us)
    leaves = written(leaves.select("groupby_col", F.col("t").alias("leave"), "next", (F.col("next") > F.col("leave") + high).cast("long").alias("gap")))
    starts = heads.groupBy("groupby_col").agg(F.min("head").alias("entry"))
    entries = leaves.where("next is not null").select("groupby_col", F.col("next").alias("entry")).unionByName(starts).distinct()
    entries = entries.withColumn("t", F.col("entry"))

    def exits(rows: pa.Table, starts: np.ndarray) -> pa.Table:
        """Every entry's last fix in the chunk and the bursts begun on the way, by pointer doubling."""
        t = rows["t"].to_numpy()
        ahead, end = _steps_ahead(t, starts, low, chunk_us)
        stay = ahead < end
        to = np.where(stay, ahead, np.arange(len(t)))
        bursts = np.where(stay & (t[to] > t + high), 1, 0)
        while not (to[to] == to).all():
            bursts, to = bursts + bursts[to], to[to]
        here = np.flatnonzero(rows["entry"].is_valid().to_numpy())
        return pa.table({"groupby_col": rows["groupby_col"].take(pa.array(here)), "entry": t[here], "leave": t[to[here]], "bursts": bursts[here].astype(np.int64)})

    times = fixes.select("groupby_col", "chunk", "t").join(entries, ["groupby_col", "t"], "left")
    order = ["groupby_col", "chunk", "t"]
    times = times.select(*order, "entry").repartition("groupby_col", "chunk").sortWithinPartitions(*order)
    crossed = times.mapInArrow(_in_groups(exits), "groupby_col string, entry long, leave long, bursts long")
    jumps = crossed.join(leaves.where("next is not null"), ["groupby_col", "leave"])
    jumps = written(jumps.select("groupby_col", "entry", F.col("next").alias("to"), (F.col("bursts") + F.col("gap")).alias("bursts")))
    true = written(starts.select("groupby_col", "entry", F.lit(0).cast("long").alias("burst")))
    while True:
        fresh = true.join(jumps, ["groupby_col", "entry"]).select("groupby_col", F.col("to").alias("entry"), (F.col("burst") + F.col("bursts")).alias("burst"))
        fresh = written(fresh.join(true, ["groupby_col", "entry"], "left_anti"))
        if fresh.isEmpty():
            break
        true = true.unionByName(fresh)
        second = jumps.select("groupby_col", F.col("entry").alias("to"), F.col("to").alias("further"), F.col("bursts").alias("more"))
        jumps = written(jumps.join(second, ["groupby_col", "to"]).select("groupby_col", "entry", F.col("further").alias("to"), (F.col("bursts") + F.col("more")).alias("bursts")))

    def walk(rows: pa.Table, starts: np.ndarray) -> pa.Table:
        t, burst = rows["t"].to_numpy(), rows["burst"].fill_null(0).to_numpy()
        ahead, end = (a.tolist() for a in _steps_ahead(t, starts, low, chunk_us))
        times, keep, bursts = t.tolist(), [], []
        entered, done = np.flatnonzero(rows["burst"].is_valid().to_numpy()).tolist(), 0
        for i in entered:
            # the first entry of a chunk is the one
            if i < done:
                continue
            b, done = int(burst[i]), end[i]
            while i < done:
                keep.append(i)
                bursts.append(b)
                b += ahead[i] < done and times[ahead[i]] > times[i] + high
                i = ahead[i]
        kept = rows.select(["groupby_col", "t", "lon", "lat"]).take(pa.array(keep, pa.int64()))
        return kept.append_column("extra__burst", pa.array(bursts, pa.int64()))

    marked = fixes.join(true.select("groupby_col", F.col("entry").alias("t"), "burst"), ["groupby_col", "t"], "left")
    marked = marked.select(*order, "lon", "lat", "burst").repartition("groupby_col", "chunk").sortWithinPartitions(*order)
    walked = marked.mapInArrow(_in_groups(walk), "groupby_col string, t long, lon double, lat double, extra__burst long")
    ends = leaves.where("next is null").select("groupby_col", F.col("leave").alias("t"))
    return walked.join(ends, ["groupby_col", "t"], "left_anti").select("groupby_col", at_micros("t").alias("fixtime"), "lon", "lat", "extra__burst")


def speed_steps(df: DataFrame) -> DataFrame:
    """Four points for each segment, so that its speed draws as a step."""
    point = lambda t, v: F.struct(F.col(t).alias("time"), v.cast("double").alias("speed"))
    v, zero = F.col("speed_kmhr"), F.lit(0.0)
    each = F.array(point("segment_start", zero), point("segment_start", v), point("segment_end", v), point("segment_end", zero))
    return df.select("groupby_col", F.posexplode(each).alias("place", "p")).select("groupby_col", "place", "p.*")
