"""Joins in space. Both sides are dealt out over square tiles, so that tiles are the equi key of the join and either side may be large."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faunaflow.functions.geodesy import with_geodesic
from faunaflow.functions.shapes import bounds, clip, contains, crossing, meets_box, point_to_segment, segment_to_shape
from faunaflow.functions.stages import written


def _tile(c: Column, size: float) -> Column:
    return F.floor(c / size)


def _tiled(df: DataFrame, x0: str, x1: str, y0: str, y1: str, size: float) -> DataFrame:
    """One row for each tile that the box meets, with the box's first tile."""
    df = df.withColumns({"tx0": _tile(F.col(x0), size), "ty0": _tile(F.col(y0), size)})
    df = df.withColumn("tx", F.explode(F.sequence("tx0", _tile(F.col(x1), size))))
    return df.withColumn("ty", F.explode(F.sequence("ty0", _tile(F.col(y1), size))))


def tiled_regions(regions: DataFrame, size: float) -> DataFrame:
    rows = regions.select("pk", "name", "ring", *bounds("ring"))
    return _tiled(rows, "bx0", "bx1", "by0", "by1", size).withColumnsRenamed({"tx0": "rx0", "ty0": "ry0"})


def points_in_regions(points: DataFrame, regions: DataFrame, x: str = "lon", y: str = "lat", tile: float = 1.0) -> DataFrame:
    """Points with spatial_index, a region's name or else its key: a row for each region that holds the point or has it on its border."""
    keyed = points.withColumns({"tx": _tile(F.col(x), tile), "ty": _tile(F.col(y), tile)})
    met = keyed.join(tiled_regions(regions, tile), ["tx", "ty"]).where(contains(F.col("ring"), F.col(x), F.col(y)))
    name = F.coalesce(F.nullif(F.col("name"), F.lit("")), F.col("pk").cast("string"))
    return met.select(*points.columns, name.alias("spatial_index"))


def segments_in_regions(segments: DataFrame, regions: DataFrame, tile: float = 1.0) -> DataFrame:
    """The part of each segment in each region, where it is one piece; distance is geodesic, time follows the speed.

    Segments cut into several pieces by a region, and touches in a point, are left out. Overlapping regions count twice.
    """
    rows = segments.withColumns({"sx0": F.least("x1", "x2"), "sx1": F.greatest("x1", "x2"), "sy0": F.least("y1", "y2"), "sy1": F.greatest("y1", "y2")})
    met = _tiled(rows, "sx0", "sx1", "sy0", "sy1", tile).join(tiled_regions(regions, tile), ["tx", "ty"])
    # of the tiles that both meet only the first counts
    met = met.where((F.col("tx") == F.greatest("tx0", "rx0")) & (F.col("ty") == F.greatest("ty0", "ry0")))
    met = met.where("sx1 >= bx0 and sx0 <= bx1 and sy1 >= by0 and sy0 <= by1")
    met = met.withColumn("parts", clip(F.col("ring"), F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))).where("size(parts) = 1")
    part = lambda a, b, t: F.col(a) + (F.col(b) - F.col(a)) * F.col("parts")[0][t]
    cut = met.withColumns({"cx1": part("x1", "x2", "t0"), "cy1": part("y1", "y2", "t0"), "cx2": part("x1", "x2", "t1"), "cy2": part("y1", "y2", "t1")})
    cut = with_geodesic(cut, "cx1", "cy1", "cx2", "cy2", "cut_dist")
    rest = [c for c in segments.columns if c not in ("x1", "y1", "x2", "y2", "dist_meters", "timespan_seconds")]
    return cut.select(
        *rest,
        F.col("name").alias("spatial_index"),
        *[F.col(f"c{c}").alias(c) for c in ("x1", "y1", "x2", "y2")],
        F.col("cut_dist").alias("dist_meters"),
        (F.try_divide(F.col("cut_dist"), F.col("speed_kmhr") * 1000) * 3600).alias("timespan_seconds"),
    )


def fence_crossings(segments: DataFrame, fences: DataFrame, tile: float = 1.0) -> DataFrame:
    """Crossings of segments with fence pieces (fence_id, fence_name, ax, ay, bx, by): where, and when by the share of the way.

    A crossing where two pieces of a fence join counts once. Further columns of the fences, such as a warn level, stay.
    """
    rows = segments.withColumns({"sx0": F.least("x1", "x2"), "sx1": F.greatest("x1", "x2"), "sy0": F.least("y1", "y2"), "sy1": F.greatest("y1", "y2")})
    walls = fences.withColumns({"wx0": F.least("ax", "bx"), "wx1": F.greatest("ax", "bx"), "wy0": F.least("ay", "by"), "wy1": F.greatest("ay", "by")})
    walls = _tiled(walls, "wx0", "wx1", "wy0", "wy1", tile).withColumnsRenamed({"tx0": "rx0", "ty0": "ry0"})
    met = _tiled(rows, "sx0", "sx1", "sy0", "sy1", tile).join(walls, ["tx", "ty"])
    met = met.where((F.col("tx") == F.greatest("tx0", "rx0")) & (F.col("ty") == F.greatest("ty0", "ry0")))
    met = met.withColumn("share", crossing(*[F.col(c) for c in ("x1", "y1", "x2", "y2", "ax", "ay", "bx", "by")])).where("share is not null")
    more = [c for c in fences.columns if c not in ("fence_id", "fence_name", "ax", "ay", "bx", "by")]
    plain = [c for c, kind in segments.dtypes if "map<" not in kind and "variant" not in kind]
    met = met.withColumn("joint", F.round("share", 9)).dropDuplicates([*plain, "fence_id", "joint"])
    return met.select(
        *segments.columns,
        "fence_id",
        "fence_name",
        *more,
        (F.col("x1") + F.col("share") * (F.col("x2") - F.col("x1"))).alias("cross_x"),
        (F.col("y1") + F.col("share") * (F.col("y2") - F.col("y1"))).alias("cross_y"),
        F.expr("timestampadd(MICROSECOND, cast(share * timestampdiff(MICROSECOND, segment_start, segment_end) as bigint), segment_start)").alias("crossing_time"),
    )


def region_lists(crossings: DataFrame, regions: DataFrame, tile: float = 1.0) -> DataFrame:
    """crossings with start_region_ids and end_region_ids: sorted keys of the regions that hold a segment's start, and its end; null where none does.

    Only distinct places meet the regions, so a segment with many crossings is looked up once.
    """
    ends = crossings.select(F.explode(F.array(F.struct(F.col("x1").alias("px"), F.col("y1").alias("py")), F.struct(F.col("x2").alias("px"), F.col("y2").alias("py")))).alias("p")).select("p.*").distinct()
    keyed = regions.select("pk", F.col("pk").cast("string").alias("name"), "ring")
    held = points_in_regions(ends, keyed, "px", "py", tile).groupBy("px", "py").agg(F.array_sort(F.collect_set("spatial_index")).alias("ids"))
    for to, x, y in (("start_region_ids", "x1", "y1"), ("end_region_ids", "x2", "y2")):
        crossings = crossings.join(held.select(F.col("px").alias(x), F.col("py").alias(y), F.col("ids").alias(to)), [x, y], "left")
    return crossings


def _distance(features: DataFrame) -> Column:
    """Of a segment to a feature: a point (fx, fy), or a shape (kind: point, line or polygon; path)."""
    ends = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    return segment_to_shape(F.col("kind"), F.col("path"), *ends) if "path" in features.columns else point_to_segment(F.col("fx"), F.col("fy"), *ends)


def proximity(segments: DataFrame, features: DataFrame) -> DataFrame:
    """Every segment with every feature, points (feature_id, fx, fy) or shapes (feature_id, kind, path), and their planar distance.

    The result is that product. Features are few by definition; Spark broadcasts them below its size threshold and pairs blocks
    otherwise. For many features take :func:`nearest_features`.
    """
    return segments.crossJoin(features).withColumn("proximity", _distance(features))


def nearest_features(segments: DataFrame, key: list[str], features: DataFrame, tile: float = 0.25) -> DataFrame:
    """key, feature_id, proximity: the nearest shape (feature_id, kind, path) of each segment, of several as near the least id.

    Segments look for features in tiles within one side of a tile of their box. A feature found within that distance is the
    nearest; segments that find none look again in tiles twice as wide, until one tile is as wide as everything. So work follows the
    features nearby, and the number of rounds the logarithm of the widest gap. Without features there are no rows.
    """
    ends = ["x1", "y1", "x2", "y2"]
    left = written(segments.select(*key, *ends).where(" and ".join(f"{c} is not null" for c in ends)))
    shapes = written(features.select("feature_id", "kind", "path", *bounds("path")))
    low = [F.min(F.least(*c)) for c in (("x1", "x2"), ("y1", "y2"))]
    high = [F.max(F.greatest(*c)) for c in (("x1", "x2"), ("y1", "y2"))]
    own, other = left.agg(*low, *high).first(), shapes.agg(F.min("bx0"), F.min("by0"), F.max("bx1"), F.max("by1")).first()
    found = None
    if own[0] is None or other[0] is None:
        return left.select(*key).join(shapes.select("feature_id", F.lit(0.0).alias("proximity")).where("false"))
    widest = max(max(own[i + 2], other[i + 2]) - min(own[i], other[i]) for i in (0, 1))
    while True:
        box = left.withColumns({"sx0": F.least("x1", "x2") - tile, "sx1": F.greatest("x1", "x2") + tile, "sy0": F.least("y1", "y2") - tile, "sy1": F.greatest("y1", "y2") + tile})
        walls = _tiled(shapes, "bx0", "bx1", "by0", "by1", tile).withColumnsRenamed({"tx0": "rx0", "ty0": "ry0"})
        met = _tiled(box, "sx0", "sx1", "sy0", "sy1", tile).join(walls, ["tx", "ty"])
        met = met.where((F.col("tx") == F.greatest("tx0", "rx0")) & (F.col("ty") == F.greatest("ty0", "ry0")))
        best = met.groupBy(*key).agg(F.min(F.struct(_distance(shapes).alias("proximity"), "feature_id")).alias("best"))
        best = best.select(*key, "best.feature_id", "best.proximity")
        last = tile >= widest
        best = written(best if last else best.where(F.col("proximity") <= tile))
        found = best if found is None else found.unionByName(best)
        if last:
            return found
        left = written(left.join(best.select(*key), key, "left_anti"))
        if left.isEmpty():
            return found
        tile *= 2


def mesh_over(regions: DataFrame, xlen: float, ylen: float, origin: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """ix, iy and bounds of the boxes that meet any of the rings, borders included; lines of the grid pass through the origin.

    An existing grid is matched by the lower left corner of one of its cells as origin. Each region lays out the boxes of its own extent.
    """
    ox, oy = origin
    rows = regions.select("ring", *bounds("ring"))
    place = lambda c, o, size: F.floor((F.col(c) - o) / size)
    rows = rows.withColumn("ix", F.explode(F.sequence(place("bx0", ox, xlen), place("bx1", ox, xlen))))
    rows = rows.withColumn("iy", F.explode(F.sequence(place("by0", oy, ylen), place("by1", oy, ylen))))
    box = {"x0": F.col("ix") * xlen + ox, "y0": F.col("iy") * ylen + oy, "x1": (F.col("ix") + 1) * xlen + ox, "y1": (F.col("iy") + 1) * ylen + oy}
    rows = rows.withColumns(box)
    return rows.where(meets_box(F.col("ring"), *[F.col(c) for c in box])).select("ix", "iy", *box).distinct()


def mesh_grid(spark: SparkSession, x0: float, y0: float, x1: float, y1: float, xlen: float, ylen: float) -> DataFrame:
    """cell_id, ix, iy and bounds of boxes over an extent, from an origin snapped down to whole cells; x varies slowest."""
    import math

    if x0 is None:  # an extent of nothing
        x0 = y0 = x1 = y1 = 0.0
    fx, fy = math.floor(x0 / xlen), math.floor(y0 / ylen)
    nx, ny = math.ceil(x1 / xlen) - fx, math.ceil(y1 / ylen) - fy
    cells = spark.range(nx * ny).select(F.col("id").alias("cell_id"), F.expr(f"id div {ny} + {fx}").alias("ix"), F.expr(f"id % {ny} + {fy}").alias("iy"))
    return cells.select(
        "*", (F.col("ix") * xlen).alias("x0"), (F.col("iy") * ylen).alias("y0"), ((F.col("ix") + 1) * xlen).alias("x1"), ((F.col("iy") + 1) * ylen).alias("y1")
    )


def grid_traversal(df: DataFrame, x1: str, y1: str, x2: str, y2: str, size: float) -> DataFrame:
    """One row for each cell that a segment passes, with share, the part of its length there.

    The cuts at the grid's lines follow from arithmetic on the row itself, without a join.
    """

    def cuts(a: str, b: str) -> Column:
        low, high = F.ceil(F.least(a, b) / size), F.floor(F.greatest(a, b) / size)
        lines = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))
        return F.transform(lines, lambda k: F.try_divide(k * size - F.col(a), F.col(b) - F.col(a)))

    ts = F.filter(F.concat(cuts(x1, x2), cuts(y1, y2)), lambda t: t.isNotNull() & (t > 0) & (t < 1))
    ts = F.sort_array(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), ts)))
    rows = df.withColumn("ts", ts).withColumn("k", F.explode(F.expr("sequence(1, size(ts) - 1)")))
    rows = rows.withColumns({"share": F.expr("ts[k] - ts[k - 1]"), "mid": F.expr("(ts[k] + ts[k - 1]) / 2")})
    cell = lambda a, b: F.floor((F.col(a) + F.col("mid") * (F.col(b) - F.col(a))) / size)
    return rows.withColumns({"ix": cell(x1, x2), "iy": cell(y1, y2)}).drop("ts", "k", "mid")


def grid_size(df: DataFrame, lon: str = "lon", lat: str = "lat", factor: int = 100) -> DataFrame:
    """size: metres of a grid cell, the geodesic diagonal of all points' box by factor, rounded half to even, at least 1; an empty table gives no row."""
    box = df.agg(F.min(lon).alias("x0"), F.min(lat).alias("y0"), F.max(lon).alias("x1"), F.max(lat).alias("y1")).where("x0 is not null and y0 is not null")
    return with_geodesic(box, "x0", "y0", "x1", "y1", "across").select(F.greatest(F.lit(1), F.rint(F.col("across") / factor).cast("long")).alias("size"))
