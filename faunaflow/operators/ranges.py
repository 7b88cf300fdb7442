"""Elliptical time density, growth of daily hulls, and cells of straight paths."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faunaflow.functions.stages import written


def weibull_fit(df: DataFrame, value: str, rounds: int = 30) -> tuple[float, float] | None:
    """Shape and scale of the likeliest Weibull distribution of the values above zero; None where fewer than two differ.

    Distinct values and their counts are written once. One pass over them tries a range of shapes, then Newton steps of three
    sums each refine the best. Values are taken relative to the largest, so that no power overflows.
    """
    rows = df.where(F.col(value) > 0).groupBy(F.col(value).cast("double").alias("x")).agg(F.count(F.lit(1)).alias("n"))
    rows = written(rows.where("not isnan(x)"))
    total, mean_log, least, most = rows.agg(F.sum("n"), F.sum(F.log("x") * F.col("n")), F.min("x"), F.max("x")).first()
    if total is None or least == most:
        return None
    mean_log /= total
    log, power = F.log("x"), lambda k: F.pow(F.col("x") / most, F.lit(float(k))) * F.col("n")

    def slope(k: float, a: float, b: float) -> float:
        """Rises with k and is zero at the likeliest shape."""
        return b / a - 1 / k - mean_log

    tried = [2.0**e for e in range(-6, 7)]
    sums = rows.agg(*[f for k in tried for f in (F.sum(power(k)), F.sum(power(k) * log))]).first()
    k = max([t for i, t in enumerate(tried) if slope(t, *sums[2 * i : 2 * i + 2]) < 0], default=tried[0])
    for _ in range(rounds):
        a, b, c = rows.agg(F.sum(power(k)), F.sum(power(k) * log), F.sum(power(k) * log * log)).first()
        step = slope(k, a, b) / ((c * a - b * b) / (a * a) + 1 / (k * k))
        k = max(k - step, k / 4)
        if abs(step) < 1e-10 * k:
            break
    return k, most * (rows.agg(F.sum(power(k))).first()[0] / total) ** (1 / k)


def weibull_pdf(x, shape: float, scale: float):
    return shape / scale * F.pow(x / scale, F.lit(shape - 1)) * F.exp(-F.pow(x / scale, F.lit(shape)))


#: Sides of the square blocks of cells in which densities are summed, the blocks that a task holds at most, and those whose weights
#: are kept, for all segments of a call together, rather than computed again.
BLOCK, HELD_BLOCKS, KEPT_BLOCKS = 256, 128, 256
#: Blocks of this side are weighed cell by cell; larger ones at POINTS x POINTS places, if both ends of the segment are GAP sides away.
LEAF, POINTS, GAP = 8, 10, 0.5
#: A weight may be off by this share of itself or by this share of the weight of the segment's first cell. Segments of one call.
TOLERANCE, NEGLIGIBLE, CALL = 1e-3, 1e-9, 2048
#: Bits of a float32 that are left out when a speed is looked up: 2^14 steps an octave, under 0.001 km/h up to 16 km/h.
_DROPPED_BITS = 9


def weibull_quantile(share: float, shape: float, scale: float) -> float:
    return scale * (-math.log(1 - share)) ** (1 / shape)


def _speed_table(least: float, most: float, shape: float, scale: float) -> tuple[int, np.ndarray]:
    """The first place, and for each place the log of the integral of the speed model from there to the largest speed."""
    place = lambda v: int(np.float32(v).view(np.int32)) >> _DROPPED_BITS
    first = place(least)
    at = (np.arange(first, place(most) + 2, dtype=np.int32) << _DROPPED_BITS).view(np.float32).astype(float)
    at[-1] = max(most, np.nextafter(at[-2], np.inf))
    mid = (at[:-1] + at[1:]) / 2
    part = (shape - 1) * np.log(mid / scale) - (mid / scale) ** shape - np.log(mid) + np.log(np.diff(at))
    return first, np.logaddexp.accumulate(part[::-1])[::-1]


class _Lattice:
    """A block of side x side cells, and the POINTS x POINTS Chebyshev places between which a smooth weight is interpolated.

    ``spread`` takes weights at the places of one axis to its cells, ``whole`` weights at all places to the sum over all cells. Away from
    the ends of its segment a weight is smooth, and the error of its interpolation is largest where the first polynomial left out is: at
    corners and near edges and the middle. ``at_probes`` takes weights to nine such cells, at ``probes``, to compare them.
    """

    def __init__(self, side: int):
        half, angle = (side - 1) / 2, (np.arange(POINTS) + 0.5) * np.pi / POINTS
        self.places, self.probes = side / 2 + half * np.cos(angle), np.array([0.5, side // 2 + 0.5, side - 0.5])
        factor = (-1.0) ** np.arange(POINTS) * np.sin(angle)

        def matrix(at: np.ndarray) -> np.ndarray:
            gap = at[:, None] - self.places
            met = np.abs(gap) < 1e-12
            weight = np.where(met.any(1, keepdims=True), met, factor / np.where(met, 1.0, gap))
            return weight / weight.sum(1, keepdims=True)

        self.spread = matrix(np.arange(side) + 0.5)
        self.whole = np.kron(self.spread.sum(0), self.spread.sum(0))
        self.at_probes = np.kron(matrix(self.probes), matrix(self.probes))


def elliptical_density(df: DataFrame, size: float, max_speed_kmhr: float, shape: float, scale: float, step: float = 0.001, extent: tuple[float, float, float, float] | None = None, tasks: int | None = None) -> DataFrame:
    """ix, iy, density: where a subject may have been between fixes, as a share of all. Planar x1, y1, x2, y2 in metres, timespan_seconds.

    A cell within reach of both ends needs the speed (d1 + d2) / t; its weight is the integral of the speed model from that speed,
    step at least, to the largest. Weights are normalised in their segment and divided by its time. An extent (x0, y0, x1, y1)
    bounds the cells by their centres.

    Every segment weighs every cell in its reach. Cells near its ends are weighed one by one. A block farther away, and wholly within
    reach, is weighed at a few places; sums over segments of the weights there are interpolated to its cells once. Where that is off, at
    nine cells, by more than TOLERANCE and NEGLIGIBLE allow, the segment takes the block in quarters. So the work for a segment grows
    with the logarithm of its cells. Memory does not grow with the reach, and only sums by cell are shuffled. Tasks (four for each
    shuffle partition, if not given) take equal numbers of segments that lie near each other, as those share their blocks; sizes in
    bytes, by which small partitions would be joined, say nothing about their work.
    """
    first, logs = _speed_table(step, max_speed_kmhr, shape, scale)

    def cells(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # cells (lowest, highest) of each axis whose centres lie in the extent
        bounds = [(math.ceil(extent[k] / size - 0.5), math.floor(extent[k + 2] / size - 0.5)) if extent else (-math.inf, math.inf) for k in (0, 1)]
        lattices, sums = {}, {}

        def lattice(side: int) -> _Lattice:
            return lattices.get(side) or lattices.setdefault(side, _Lattice(side))

        def inside(start: int, side: int, axis: int) -> slice:
            """The cells of a block, counted from its first, that lie in the extent."""
            low, high = bounds[axis]
            return slice(int(min(max(low - start, 0), side)), int(max(min(high + 1 - start, side), 0)))

        def flush() -> pd.DataFrame:
            out = []
            for (bx, by), (plain, coarse) in sums.items():
                for (side, i, j), at in coarse.items():
                    across, along = inside(bx + i, side, 0), inside(by + j, side, 1)
                    spread = lattice(side).spread
                    # every weight in such a block is above zero, so its cells stay, however small
                    plain[i : i + side, j : j + side][across, along] += np.maximum(spread[across] @ at.reshape(POINTS, POINTS) @ spread[along].T, np.finfo(float).tiny)
                i, j = np.nonzero(plain)
                out.append(pd.DataFrame({"ix": i + bx, "iy": j + by, "v": plain[i, j]}))
            sums.clear()
            return pd.concat(out) if out else pd.DataFrame({"ix": [], "iy": [], "v": []})

        def away(at: np.ndarray, start: int, side: int) -> np.ndarray:
            """Metres along one axis from a place to a block."""
            return np.maximum(np.maximum(start * size - at, at - (start + side) * size), 0.0)

        def speeds(ends: np.ndarray, xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
            """The speed that each place (x, y), in cells, takes of each segment; segments stand in the last axis, which is long."""
            square = lambda places, a: ((places[:, None] * size - a) ** 2).astype(np.float32)
            speed = np.sqrt(square(xs, ends[0])[:, None] + square(ys, ends[1]))
            speed += np.sqrt(square(xs, ends[2])[:, None] + square(ys, ends[3]))
            speed *= np.float32(3.6) / ends[4].astype(np.float32)
            return speed.reshape(len(xs) * len(ys), -1)

        def look_up(table: np.ndarray, speed: np.ndarray) -> np.ndarray:
            place = speed.view(np.int32) >> _DROPPED_BITS
            place -= first
            return table[np.clip(place, 0, len(table) - 1, out=place)]

        def pieces(ends: np.ndarray, table: np.ndarray, x: int, y: int, side: int, who: np.ndarray, least: np.ndarray, reach: list) -> Iterator[tuple]:
            """(first cells of the block, its side, whether its places are taken, segments, their weights), which make up the block."""
            across, along = inside(x, side, 0), inside(y, side, 1)
            if across.start >= across.stop or along.start >= along.stop:
                return
            if not (reach[0] <= x * size and (x + side) * size <= reach[2] and reach[1] <= y * size and (y + side) * size <= reach[3]):
                cx, cy, r = (ends[0, who] + ends[2, who]) / 2, (ends[1, who] + ends[3, who]) / 2, max_speed_kmhr / 3.6 * ends[4, who] / 2
                who = who[(away(cx, x, side) <= r) & (away(cy, y, side) <= r)]
            if side > LEAF and side % 2 == 0:
                gap = np.minimum(*[np.hypot(away(ends[k, who], x, side), away(ends[k + 1, who], y, side)) for k in (0, 2)])
                # not where the weight of the least speed, step, begins
                far = (gap >= GAP * side * size) & (2 * 3.6 * gap >= 2 * step * ends[4, who])
                if far.any():
                    net, some = lattice(side), who[far]
                    own = ends[:, some]
                    probed = speeds(own, x + net.probes, y + net.probes)
                    want, at = look_up(table, probed), look_up(table, speeds(own, x + net.places, y + net.places))
                    off = np.abs(net.at_probes @ at - want)
                    # a sum of distances is largest at a corner
                    good = (off <= np.maximum(TOLERANCE * want, NEGLIGIBLE * least[some])).all(0) & (want > 0).all(0) & (probed < max_speed_kmhr).all(0)
                    if good.any():
                        yield (x, y), side, True, some[good], at[:, good]
                    far[far] = good
                    who = who[~far]
                if len(who):
                    for i in (x, x + side // 2):
                        for j in (y, y + side // 2):
                            yield from pieces(ends, table, i, j, side // 2, who, least, reach)
            elif len(who):
                speed = speeds(ends[:, who], x + np.arange(across.start, across.stop) + 0.5, y + np.arange(along.start, along.stop) + 0.5)
                yield (x, y), side, False, who, look_up(table, speed) * (speed < max_speed_kmhr)

        def share(x: int, y: int, side: int) -> np.ndarray:
            """What a weight at each place counts in the sum over the block's cells."""
            spread = lattice(side).spread
            if all(bounds[k][0] <= a and a + side - 1 <= bounds[k][1] for k, a in enumerate((x, y))):
                return lattice(side).whole
            return np.kron(spread[inside(x, side, 0)].sum(0), spread[inside(y, side, 1)].sum(0))

        def call(ends: np.ndarray, table: np.ndarray) -> Iterator[pd.DataFrame]:
            reach = max_speed_kmhr / 3.6 * ends[4] / 2
            # the weight of the cell in which a segment starts is no less than this, if it lies in the extent
            speed = (np.hypot(ends[2] - ends[0], ends[3] - ends[1]) + 1.5 * size) / ends[4] * 3.6
            begun = np.logical_and(*[(a <= (at := np.floor(ends[k] / size))) & (at <= b) for k, (a, b) in enumerate(bounds)]) & (speed < max_speed_kmhr)
            least = look_up(table, speed.astype(np.float32)) * begun
            middles = [(ends[k] + ends[k + 2]) / 2 for k in (0, 1)]
            # the box in which all reaches agree
            common = [(m - reach).max() for m in middles] + [(m + reach).min() for m in middles]
            ranges = []
            for k, middle in enumerate(middles):
                low, high = max((middle - reach).min() / size - 0.5, bounds[k][0]), min((middle + reach).max() / size - 0.5, bounds[k][1])
                ranges.append(range(math.ceil(low) // BLOCK, math.floor(high) // BLOCK + 1))
            again = lambda: (p for bx in ranges[0] for by in ranges[1] for p in pieces(ends, table, bx * BLOCK, by * BLOCK, BLOCK, np.arange(ends.shape[1]), least, common))
            total, kept, held = np.zeros(ends.shape[1]), [], 0
            for piece in again():
                (x, y), side, coarse, who, weights = piece
                total[who] += share(x, y, side) @ weights if coarse else weights.sum(0)
                held += weights.size
                if kept is not None:
                    kept.append(piece)
                    if held > KEPT_BLOCKS * BLOCK * BLOCK:
                        kept = None
                        if ends.shape[1] > 1:
                            for half in np.array_split(ends, 2, axis=1):
                                yield from call(half, table)
                            return
            factor = np.divide(1.0, total * ends[4], out=np.zeros_like(total), where=total > 0)
            for (x, y), side, coarse, who, weights in again() if kept is None else kept:
                key = x // BLOCK * BLOCK, y // BLOCK * BLOCK
                if key not in sums:
                    if len(sums) >= HELD_BLOCKS:
                        yield flush()
                    sums[key] = np.zeros((BLOCK, BLOCK)), {}
                plain, at = sums[key]
                i, j, value = x - key[0], y - key[1], weights @ factor[who]
                if coarse:
                    at[side, i, j] = at.get((side, i, j), 0.0) + value
                else:
                    across, along = inside(x, side, 0), inside(y, side, 1)
                    plain[i : i + side, j : j + side][across, along] += value.reshape(across.stop - across.start, -1)

        for part in parts:
            ends = part.to_numpy(dtype=float).T
            straight = (np.hypot(ends[2] - ends[0], ends[3] - ends[1]) / ends[4] * 3.6).astype(np.float32)
            low = logs[np.clip((straight.view(np.int32) >> _DROPPED_BITS) - first, 0, len(logs) - 1)]
            # as factors of a segment cancel, very small weights are taken relative to one near its largest
            depth = ((logs[0] - low) // 40).astype(int)
            near = np.floor(ends[:2] / (size * LEAF))
            order = np.lexsort((near[1], near[0], depth))
            for d in np.unique(depth):
                table = np.exp(np.minimum(logs - (logs[0] - 40 * (d + 1) * (d > 0)), 80.0))
                own = order[depth[order] == d]
                for k in range(0, len(own), CALL):
                    yield from call(ends[:, own[k : k + CALL]], table)
        yield flush()

    tasks = tasks or 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ends = ["x1", "y1", "x2", "y2", "timespan_seconds"]
    tiles = [F.floor(F.col(c) / (size * 4 * LEAF)).alias(f"tile_{c}") for c in ends[:2]]
    rows = df.where("timespan_seconds > 0").select(*ends, *tiles, F.rand(0).alias("u")).repartitionByRange(tasks, "tile_x1", "tile_y1", "u").select(*ends)
    got = rows.mapInPandas(cells, "ix long, iy long, v double").groupBy("ix", "iy").agg(F.sum("v").alias("v"))
    total = got.agg(F.sum("v").alias("total"))
    return got.join(F.broadcast(total)).select("ix", "iy", F.try_divide("v", "total").alias("density"))


def _corners(points: list[tuple]) -> list[tuple]:
    """Corners of the convex hull of (x, y) in plain numbers, by the monotone chain; of fewer than three points themselves, sorted."""
    points = sorted(set(points))
    if len(points) < 3:
        return points
    found = []
    for line in (points, points[::-1]):
        chain: list = []
        for x, y in line:
            while len(chain) > 1:
                (ox, oy), (ax, ay) = chain[-2], chain[-1]
                if (ax - ox) * (y - oy) - (ay - oy) * (x - ox) > 0:
                    break
                chain.pop()
            chain.append((x, y))
        found += chain[:-1]
    return found


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, by the monotone chain."""
    return np.array(_corners(list(map(tuple, np.asarray(points, dtype=float).tolist())))).reshape(-1, 2)


def _area(corners: list[tuple]) -> float:
    """The area within a ring; its first corner is taken as the origin, so that no large products cancel."""
    if len(corners) < 3:
        return 0.0
    (x0, y0), total = corners[0], 0.0
    for (ax, ay), (bx, by) in zip(corners[1:], corners[2:]):
        total += (ax - x0) * (by - y0) - (bx - x0) * (ay - y0)
    return abs(total) / 2


def _hulls(xs: pd.Series, ys: pd.Series) -> pd.DataFrame:
    """The hull of each list of points; null for null."""
    each = [None if x is None else _corners(list(zip(x.tolist(), y.tolist()))) for x, y in zip(xs, ys)]
    return pd.DataFrame({k: [None if h is None else [p[i] for p in h] for h in each] for i, k in enumerate(("xs", "ys"))})


#: Lists of so few points are left as they are: hulls in front of them cost more than they save.
FEW = 8


def _shrunk(df: DataFrame) -> DataFrame:
    """df with the lists xs, ys of the corners of their hulls alone; lists of few points stay, and are not handed to Python."""
    many, hulls = F.size("xs") > FEW, F.pandas_udf(_hulls, "xs array<double>, ys array<double>")
    got = df.withColumn("h", hulls(F.when(many, F.col("xs")), F.when(many, F.col("ys"))))
    return got.withColumns({c: F.coalesce(f"h.{c}", c) for c in ("xs", "ys")}).drop("h")


def _hulls_through(chunks: DataFrame) -> DataFrame:
    """groupby_col, place, xs, ys: the hull of a subject's chunks up to and with each, by doubling the reach in each round."""
    now, reach = written(chunks.select("groupby_col", "place", "xs", "ys")), 1
    most = now.agg(F.max("place")).first()[0] or 0
    while reach < most:
        behind = now.select("groupby_col", (F.col("place") + reach).alias("place"), F.col("xs").alias("us"), F.col("ys").alias("vs"))
        both = now.join(behind, ["groupby_col", "place"], "left")
        joined = {a: F.concat(a, F.coalesce(b, F.array().cast("array<double>"))) for a, b in (("xs", "us"), ("ys", "vs"))}
        now, reach = written(_shrunk(both.select("groupby_col", "place", *[c.alias(a) for a, c in joined.items()]))), 2 * reach
    return now


def _grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """groupby_col, day, area_km2 of rows (groupby_col, chunk, day, xs, ys) that stand in the order of the first three.

    The hull so far is carried from row to row, across batches too; a chunk's row without a day is what stands before it.
    """
    last, now = None, []
    for batch in batches:
        xs, ys = batch.column("xs"), batch.column("ys")
        ends, x, y = xs.offsets.to_pylist(), xs.values.to_pylist(), ys.values.to_pylist()
        subjects, chunks, days = (batch.column(c).to_pylist() for c in ("groupby_col", "chunk", "day"))
        areas = []
        for i, key in enumerate(zip(subjects, chunks)):
            points = list(zip(x[ends[i] : ends[i + 1]], y[ends[i] : ends[i + 1]]))
            now = _corners(now + points if key == last else points)
            last = key
            areas.append(_area(now) / 1e6)
        out = pa.RecordBatch.from_arrays([batch.column("groupby_col"), batch.column("day"), pa.array(areas, pa.float64())], ["groupby_col", "day", "area_km2"])
        yield out.filter(pa.array([d is not None for d in days], pa.bool_()))


def hull_growth(df: DataFrame, chunk: str = "month") -> DataFrame:
    """groupby_col, day, area_km2 of the hull of all fixes so far (planar x, y in metres, day a date).

    A day's fixes are one row with a list of places, which shrinks to the corners of its hull where there are many. Merging hulls is
    associative, so the hull in front of every chunk of time comes from a parallel prefix over chunks; then the days of a chunk are
    gone through in order, from that hull. Tasks stream sorted rows, so that many small subjects cost no call each. Fixes without a
    subject, day or place are left out.
    """
    rows = df.where("groupby_col is not null and day is not null and x is not null and y is not null")
    days = rows.groupBy("groupby_col", "day").agg(F.collect_set(F.struct(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))).alias("p"))
    days = _shrunk(days.select("groupby_col", F.trunc("day", chunk).alias("chunk"), "day", F.col("p.x").alias("xs"), F.col("p.y").alias("ys")))
    days = written(days)
    along = Window.partitionBy("groupby_col").orderBy("chunk")
    places = days.select("groupby_col", "chunk").distinct().select("groupby_col", "chunk", F.row_number().over(along).alias("place"), F.lead("chunk").over(along).alias("next"))
    # the hull of a subject's last chunk stands before no other
    places = written(places.where("next is not null"))
    chunks = days.join(places, ["groupby_col", "chunk"]).groupBy("groupby_col", "place").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("xs", "ys")])
    before = _hulls_through(_shrunk(chunks)).join(places, ["groupby_col", "place"])
    base = before.select("groupby_col", F.col("next").alias("chunk"), F.lit(None).cast("date").alias("day"), "xs", "ys")
    order = ["groupby_col", "chunk", "day"]
    both = days.select(*order, "xs", "ys").unionByName(base).repartition("groupby_col", "chunk").sortWithinPartitions(*order)
    return both.mapInArrow(_grown, "groupby_col string, day date, area_km2 double")
