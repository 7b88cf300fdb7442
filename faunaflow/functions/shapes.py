"""Planar geometry in column arithmetic: rings are arrays of struct<x, y>, closed implicitly."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def edges(ring: Column) -> Column:
    """Array of struct<a, b> of the ring's sides."""
    return F.zip_with(ring, F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def contains(ring: Column, x: Column, y: Column) -> Column:
    """Whether a point lies in the ring; its border counts."""

    def crossed(e: Column) -> Column:
        a, b = e["a"], e["b"]
        return ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * F.try_divide(y - a["y"], b["y"] - a["y"]) + a["x"])

    def touched(e: Column) -> Column:
        a, b = e["a"], e["b"]
        on_line = (b["x"] - a["x"]) * (y - a["y"]) == (b["y"] - a["y"]) * (x - a["x"])
        return on_line & x.between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])) & y.between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))

    sides = edges(ring)
    odd = F.aggregate(sides, F.lit(False), lambda s, e: s != F.coalesce(crossed(e), F.lit(False)))
    return F.exists(sides, touched) | odd


def clip(ring: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Array of struct<t0, t1>: the parts of a segment, as shares of its length, whose inside lies in the ring."""

    def at(e: Column) -> Column:
        """Where the segment's line meets the side, as a share of the segment; null where parallel."""
        a, b = e["a"], e["b"]
        dx, dy, ex, ey = x2 - x1, y2 - y1, b["x"] - a["x"], b["y"] - a["y"]
        return F.try_divide((a["x"] - x1) * ey - (a["y"] - y1) * ex, dx * ey - dy * ex)

    cuts = F.filter(F.transform(edges(ring), at), lambda t: t.isNotNull() & (t > 0) & (t < 1))
    cuts = F.sort_array(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), cuts)))
    parts = F.zip_with(F.slice(cuts, 1, F.size(cuts) - 1), F.slice(cuts, 2, F.size(cuts) - 1), lambda p, q: F.struct(p.alias("t0"), q.alias("t1")))
    inside = F.filter(parts, lambda p: contains(ring, x1 + (x2 - x1) * (p["t0"] + p["t1"]) / 2, y1 + (y2 - y1) * (p["t0"] + p["t1"]) / 2))
    # parts that follow each other are one
    start = F.array().cast("array<struct<t0:double,t1:double>>")
    last = lambda s: F.element_at(s, -1)

    def join(s: Column, p: Column) -> Column:
        grown = F.concat(F.slice(s, 1, F.size(s) - 1), F.array(F.struct(last(s)["t0"].alias("t0"), p["t1"].alias("t1"))))
        return F.when((F.size(s) > 0) & (F.try_element_at(s, F.lit(-1))["t1"] == p["t0"]), grown).otherwise(F.concat(s, F.array(p)))

    return F.aggregate(inside, start, join)


def point_to_segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    dx, dy = bx - ax, by - ay
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide((px - ax) * dx + (py - ay) * dy, dx * dx + dy * dy), F.lit(0.0))))
    return F.hypot(px - ax - t * dx, py - ay - t * dy)


def crossing(x1: Column, y1: Column, x2: Column, y2: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """The share of the first segment at which it crosses the second; null where it does not."""
    det = (x2 - x1) * (by - ay) - (y2 - y1) * (bx - ax)
    t = F.try_divide((ax - x1) * (by - ay) - (ay - y1) * (bx - ax), det)
    u = F.try_divide((ax - x1) * (y2 - y1) - (ay - y1) * (x2 - x1), det)
    return F.when(t.between(0, 1) & u.between(0, 1), t)


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once however often ``then`` refers to it.

    In the arguments of a lambda function Spark computes an expression anew wherever it stands, however dear it is.
    """
    return F.get(F.transform(F.array(value), then), 0)


def _twice_area(sides: Column) -> Column:
    return F.aggregate(sides, F.lit(0.0), lambda s, e: s + e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])


def area(ring: Column) -> Column:
    return once(ring, lambda r: F.abs(_twice_area(edges(r)))) / 2


def centroid(ring: Column) -> Column:
    """struct<x, y> of a ring's area; of its corners where it has none."""
    weighed = lambda sides, k: F.aggregate(sides, F.lit(0.0), lambda s, e: s + (e["a"][k] + e["b"][k]) * (e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]))
    mean = lambda r, k: F.aggregate(r, F.lit(0.0), lambda s, p: s + p[k]) / F.size(r)
    found = lambda r, sides, twice: F.struct(*[F.coalesce(F.try_divide(weighed(sides, k), 3 * twice), mean(r, k)).alias(k) for k in ("x", "y")])
    return once(ring, lambda r: once(edges(r), lambda sides: once(_twice_area(sides), lambda twice: found(r, sides, twice))))


def bounds(ring: str) -> list[Column]:
    """The box of a ring: bx0, by0, bx1, by1."""
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return [F.array_min(xs).alias("bx0"), F.array_min(ys).alias("by0"), F.array_max(xs).alias("bx1"), F.array_max(ys).alias("by1")]


def _share(top: np.ndarray, bottom: np.ndarray) -> np.ndarray:
    """top by bottom, nan where that is zero."""
    return np.divide(top, bottom, out=np.full(len(top), np.nan), where=bottom != 0)


def _to_segments(px, py, ax, ay, bx, by) -> np.ndarray:
    """The distance of points to segments, or to the point that a segment without length is."""
    dx, dy = bx - ax, by - ay
    along, square = (px - ax) * dx + (py - ay) * dy, dx * dx + dy * dy
    t = np.clip(np.divide(along, square, out=np.zeros(len(along)), where=square != 0), 0.0, 1.0)
    return np.hypot(px - ax - t * dx, py - ay - t * dy)


#: Sides of shapes that a task compares at once.
SIDES = 1 << 18


def _nearest_sides(polygon: np.ndarray, size: np.ndarray, start: np.ndarray, xs: np.ndarray, ys: np.ndarray, ends: list[np.ndarray]) -> np.ndarray:
    """The distance of each segment to its shape of ``size`` corners from ``start`` on; every shape has corners."""
    owner = np.repeat(np.arange(len(size)), size)
    first = np.cumsum(size) - size
    step = np.arange(len(owner)) - first[owner]
    last = step == size[owner] - 1
    here = start[owner] + step
    # a polygon's last side leads back to its first corner, that of a line is its last corner alone
    then = np.where(last, np.where(polygon[owner], start[owner], here), here + 1)
    ax, ay, bx, by = xs[here], ys[here], xs[then], ys[then]
    x1, y1, x2, y2 = (e[owner] for e in ends)
    away = np.minimum(np.minimum(_to_segments(ax, ay, x1, y1, x2, y2), _to_segments(bx, by, x1, y1, x2, y2)), np.minimum(_to_segments(x1, y1, ax, ay, bx, by), _to_segments(x2, y2, ax, ay, bx, by)))
    det = (x2 - x1) * (by - ay) - (y2 - y1) * (bx - ax)
    t, u = _share((ax - x1) * (by - ay) - (ay - y1) * (bx - ax), det), _share((ax - x1) * (y2 - y1) - (ay - y1) * (x2 - x1), det)
    away[(t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)] = 0.0
    # a polygon holds the segment's start: on its border, or after an odd number of crossings
    share = _share(y1 - ay, by - ay)
    odd = np.add.reduceat(((ay > y1) != (by > y1)) & (x1 < (bx - ax) * share + ax), first, dtype=np.int64) % 2 == 1
    out = np.minimum.reduceat(away, first)
    out[polygon & odd] = 0.0
    return out


@F.arrow_udf(DoubleType())
def _distances(polygon: pa.Array, path: pa.Array, x1: pa.Array, y1: pa.Array, x2: pa.Array, y2: pa.Array) -> pa.Array:
    """Column by column over a batch of segments and shapes, some SIDES sides at a time; null where anything is missing."""
    number = lambda a: a.cast("double").to_numpy(zero_copy_only=False)
    ends, corners = [number(e) for e in (x1, y1, x2, y2)], path.flatten()
    xs, ys = (number(corners.field(k)) for k in ("x", "y"))
    size = path.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    start = np.cumsum(size) - size
    is_polygon, out = polygon.fill_null(False).to_numpy(zero_copy_only=False), np.full(len(size), np.nan)
    rows = np.flatnonzero(size)
    parts = np.cumsum(size[rows]) // SIDES
    for part in np.split(rows, np.flatnonzero(np.diff(parts)) + 1) if len(rows) else []:
        out[part] = _nearest_sides(is_polygon[part], size[part], start[part], xs, ys, [e[part] for e in ends])
    return pa.array(out, from_pandas=True)


def segment_to_shape(kind: Column, path: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """The planar distance of a segment to a point, a line or a polygon, given as an array of struct<x, y>.

    It is 0 where they meet and where the segment lies in the polygon. It is computed for whole Arrow batches.
    """
    return _distances(kind == "polygon", path, x1, y1, x2, y2)


def meets_box(ring: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Whether a ring and a box have a point in common: a corner in the other, or sides that cross."""
    walls = [(x0, y0, x1, y0), (x1, y0, x1, y1), (x1, y1, x0, y1), (x0, y1, x0, y0)]

    def enters(side: Column) -> Column:
        a, b = side["a"], side["b"]
        found = a["x"].between(x0, x1) & a["y"].between(y0, y1)
        for wall in walls:
            found = found | crossing(a["x"], a["y"], b["x"], b["y"], *wall).isNotNull()
        return found

    return F.exists(edges(ring), enters) | contains(ring, x0, y0)
