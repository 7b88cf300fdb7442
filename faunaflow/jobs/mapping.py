"""Space: regions, fences, grids, densities."""

from __future__ import annotations

from pyspark.sql import functions as F

from faunaflow.functions.times import micros
from faunaflow.jobs.tables import SQL_FIXES, SQL_REGIONS, SQL_SEGMENTS, fixes, regions, table
from faunaflow.jobs.tracking import segments
from faunaflow.operators import density as D
from faunaflow.operators import spatial as P

QUERIES, SQL = {}, {}
SEG, FIX = f"WITH {SQL_SEGMENTS}, {SQL_REGIONS} ", f"WITH {SQL_FIXES}, {SQL_REGIONS} "


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


query("j7_points_in_regions", FIX + "SELECT event_id, name AS spatial_index FROM fixes JOIN regions ON lon BETWEEN x0 AND x1 AND lat BETWEEN y0 AND y1")(
    lambda s, d: P.points_in_regions(fixes(s, d), regions(s, d)).select(F.col("extra__event_id").alias("event_id"), "spatial_index")
)
_CLIP = SEG + """, c AS (SELECT s.*, name, r.x0 AS rx0, r.x1 AS rx1, r.y0 AS ry0, r.y1 AS ry1,
  greatest(0e0, CASE WHEN x2 = s.x1 THEN 0e0 ELSE least((r.x0 - s.x1) / (x2 - s.x1), (r.x1 - s.x1) / (x2 - s.x1)) END, CASE WHEN y2 = s.y1 THEN 0e0 ELSE least((r.y0 - s.y1) / (y2 - s.y1), (r.y1 - s.y1) / (y2 - s.y1)) END) AS t0,
  least(1e0, CASE WHEN x2 = s.x1 THEN 1e0 ELSE greatest((r.x0 - s.x1) / (x2 - s.x1), (r.x1 - s.x1) / (x2 - s.x1)) END, CASE WHEN y2 = s.y1 THEN 1e0 ELSE greatest((r.y0 - s.y1) / (y2 - s.y1), (r.y1 - s.y1) / (y2 - s.y1)) END) AS t1
  FROM segments s JOIN regions r ON greatest(s.x1, x2) >= r.x0 AND least(s.x1, x2) <= r.x1 AND greatest(s.y1, y2) >= r.y0 AND least(s.y1, y2) <= r.y1)
SELECT event_id, name AS spatial_index, round(t1 - t0, 6) AS share FROM c WHERE t1 > t0"""


@query("j6_segments_in_regions", _CLIP)
def j6(s, d):
    whole = segments(s, d)
    got = P.segments_in_regions(whole.withColumns({"ox": F.col("x2") - F.col("x1"), "oy": F.col("y2") - F.col("y1")}), regions(s, d))
    share = F.coalesce(F.try_divide(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")), F.hypot("ox", "oy")), F.lit(1.0))
    return got.select(F.col("extra__event_id").alias("event_id"), "spatial_index", F.round(share, 6).alias("share"))


def fences(s):
    """A fence of two pieces across the area."""
    return s.range(2).selectExpr("id as fence_id", "concat('fence ', id) as fence_name", "355e-1 + id as ax", "-2e0 as ay", "365e-1 as bx", "2e0 - 4 * id as by")


query("j8_fence_crossings", SEG + """, f AS (SELECT k AS fence_id, 'fence ' || k AS fence_name, 355e-1 + k AS ax, -2e0 AS ay, 365e-1 AS bx, 2e0 - 4 * k AS fy FROM (SELECT unnest(range(2)) AS k)),
c AS (SELECT *, ((ax - x1) * (fy - ay) - (ay - y1) * (bx - ax)) / nullif((x2 - x1) * (fy - ay) - (y2 - y1) * (bx - ax), 0) AS t, ((ax - x1) * (y2 - y1) - (ay - y1) * (x2 - x1)) / nullif((x2 - x1) * (fy - ay) - (y2 - y1) * (bx - ax), 0) AS u FROM segments, f)
SELECT event_id, fence_id, round(x1 + t * (x2 - x1), 6) AS cross_x, round(y1 + t * (y2 - y1), 6) AS cross_y FROM c WHERE t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1""")(
    lambda s, d: P.fence_crossings(segments(s, d), fences(s)).select(F.col("extra__event_id").alias("event_id"), "fence_id", F.round("cross_x", 6).alias("cross_x"), F.round("cross_y", 6).alias("cross_y"))
)
@query("j8_fence_regions", SEG + """, f AS (SELECT k AS fence_id, 355e-1 + k AS ax, -2e0 AS ay, 365e-1 AS bx, 2e0 - 4 * k AS fy FROM (SELECT unnest(range(2)) AS k)),
c AS (SELECT *, ((ax - x1) * (fy - ay) - (ay - y1) * (bx - ax)) / nullif((x2 - x1) * (fy - ay) - (y2 - y1) * (bx - ax), 0) AS t, ((ax - x1) * (y2 - y1) - (ay - y1) * (x2 - x1)) / nullif((x2 - x1) * (fy - ay) - (y2 - y1) * (bx - ax), 0) AS u FROM segments, f),
h AS (SELECT event_id, fence_id, x1, y1, x2, y2 FROM c WHERE t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1)
SELECT event_id, fence_id, 'level ' || fence_id AS warn_level, (SELECT string_agg(pk::VARCHAR, ',' ORDER BY pk::VARCHAR) FROM regions WHERE h.x1 BETWEEN x0 AND regions.x1 AND h.y1 BETWEEN y0 AND regions.y1) AS before,
 (SELECT string_agg(pk::VARCHAR, ',' ORDER BY pk::VARCHAR) FROM regions WHERE h.x2 BETWEEN x0 AND regions.x1 AND h.y2 BETWEEN y0 AND regions.y1) AS after FROM h""".replace("WITH ", f"WITH {SQL_REGIONS}, ", 1))
def j8_regions(s, d):
    walls = fences(s).withColumn("warn_level", F.concat(F.lit("level "), "fence_id"))
    rows = P.region_lists(P.fence_crossings(segments(s, d), walls), regions(s, d))
    return rows.select(F.col("extra__event_id").alias("event_id"), "fence_id", "warn_level", F.array_join("start_region_ids", ",").alias("before"), F.array_join("end_region_ids", ",").alias("after"))


query("j9_proximity", SEG + """SELECT event_id, pk AS feature_id, round(sqrt((px - t * dx) ** 2 + (py - t * dy) ** 2), 6) AS proximity FROM (SELECT *, greatest(0, least(1, coalesce((px * dx + py * dy) / nullif(dx * dx + dy * dy, 0), 0))) AS t
FROM (SELECT event_id, pk, x2 - s.x1 AS dx, y2 - s.y1 AS dy, r.x0 - s.x1 AS px, r.y0 - s.y1 AS py FROM segments s, regions r))""")(
    lambda s, d: P.proximity(segments(s, d), regions(s, d).selectExpr("pk as feature_id", "ring[0].x as fx", "ring[0].y as fy")).select(F.col("extra__event_id").alias("event_id"), "feature_id", F.round("proximity", 6).alias("proximity"))
)
def shapes(s, d):
    """Of each nation's rectangle the two halves on a diagonal as a polygon and a line, by odd and even keys."""
    x, y = "34e0 + (n_nationkey % 5)", "-2e0 + 8e-1 * (n_nationkey div 5)"
    corner = lambda a, b: f"named_struct('x', {x} + {a}, 'y', {y} + {b})"
    triangle, line = f"array({corner(0, 0)}, {corner(1, 0)}, {corner(0, '8e-1')})", f"array({corner(0, 0)}, {corner(1, '8e-1')})"
    return table(s, d, "nation").selectExpr("n_nationkey as feature_id", "if(n_nationkey % 2 = 1, 'polygon', 'line') as kind", f"if(n_nationkey % 2 = 1, {triangle}, {line}) as path")


def _to_segment(px, py, ax, ay, bx, by):
    t = f"greatest(0, least(1, coalesce((({px} - {ax}) * ({bx} - {ax}) + ({py} - {ay}) * ({by} - {ay})) / nullif(({bx} - {ax}) ** 2 + ({by} - {ay}) ** 2, 0), 0)))"
    return f"sqrt(({px} - {ax} - {t} * ({bx} - {ax})) ** 2 + ({py} - {ay} - {t} * ({by} - {ay})) ** 2)"


_SHAPES = SEG + f""", corners AS (SELECT n_nationkey AS pk, n_nationkey % 2 = 1 AS poly, 34e0 + (n_nationkey % 5) AS x, -2e0 + 8e-1 * (n_nationkey // 5) AS y FROM nation),
pieces AS (SELECT pk, poly, x, y, x AS ax, y AS ay, x + 1 AS bx, CASE WHEN poly THEN y ELSE y + 8e-1 END AS wy FROM corners UNION ALL SELECT pk, poly, x, y, x + 1, y, x, y + 8e-1 FROM corners WHERE poly UNION ALL SELECT pk, poly, x, y, x, y + 8e-1, x, y FROM corners WHERE poly),
met AS (SELECT *, (x2 - x1) * (wy - ay) - (y2 - y1) * (bx - ax) AS det FROM segments, pieces),
near AS (SELECT event_id, pk, min(CASE WHEN poly AND x1 >= x AND y1 >= y AND (x1 - x) + (y1 - y) / 8e-1 <= 1 THEN 0
  WHEN ((ax - x1) * (wy - ay) - (ay - y1) * (bx - ax)) / nullif(det, 0) BETWEEN 0 AND 1 AND ((ax - x1) * (y2 - y1) - (ay - y1) * (x2 - x1)) / nullif(det, 0) BETWEEN 0 AND 1 THEN 0
  ELSE least({_to_segment("ax", "ay", "x1", "y1", "x2", "y2")}, {_to_segment("bx", "wy", "x1", "y1", "x2", "y2")}, {_to_segment("x1", "y1", "ax", "ay", "bx", "wy")}, {_to_segment("x2", "y2", "ax", "ay", "bx", "wy")}) END) AS proximity FROM met GROUP BY 1, 2) """
query("j9_proximity_to_shapes", _SHAPES + "SELECT event_id, pk AS feature_id, round(proximity, 6) AS proximity FROM near")(
    lambda s, d: P.proximity(segments(s, d), shapes(s, d)).select(F.col("extra__event_id").alias("event_id"), "feature_id", F.round("proximity", 6).alias("proximity"))
)
query("j9_nearest_shape", _SHAPES + "SELECT event_id, round(min(proximity), 6) AS proximity FROM near GROUP BY 1")(
    lambda s, d: P.nearest_features(segments(s, d).withColumnRenamed("extra__event_id", "event_id"), ["event_id"], shapes(s, d)).select("event_id", F.round("proximity", 6).alias("proximity"))
)
query("g4_mesh_over_shapes", """WITH c AS (SELECT 34e0 + (n_nationkey % 5) AS x, -2e0 + 8e-1 * (n_nationkey // 5) AS y FROM nation WHERE n_nationkey % 2 = 1),
b AS (SELECT *, unnest(range(floor(x / 29e-2)::BIGINT, floor((x + 1) / 29e-2)::BIGINT + 1)) AS ix FROM c), g AS (SELECT *, unnest(range(floor(y / 17e-2)::BIGINT, floor((y + 8e-1) / 17e-2)::BIGINT + 1)) AS iy FROM b)
SELECT DISTINCT ix, iy FROM g WHERE greatest(ix * 29e-2, x) - x + (greatest(iy * 17e-2, y) - y) / 8e-1 <= 1""")(
    lambda s, d: P.mesh_over(shapes(s, d).where("kind = 'polygon'").withColumnRenamed("path", "ring"), 0.29, 0.17).select("ix", "iy")
)
query("g4_mesh_grid", FIX + """, e AS (SELECT floor(min(lon) / 25e-2)::BIGINT AS fx, floor(min(lat) / 2e-1)::BIGINT AS fy, ceil(max(lon) / 25e-2)::BIGINT AS tx, ceil(max(lat) / 2e-1)::BIGINT AS ty FROM fixes)
SELECT (ix - fx) * (ty - fy) + iy - fy AS cell_id, round(ix * 25e-2, 6) AS x0, round(iy * 2e-1, 6) AS y0 FROM (SELECT *, unnest(range(fx, tx)) AS ix FROM e) a, LATERAL (SELECT unnest(range(a.fy, a.ty)) AS iy) b""")(
    lambda s, d: P.mesh_grid(s, *_extent(fixes(s, d)), 0.25, 0.2).select("cell_id", F.round("x0", 6).alias("x0"), F.round("y0", 6).alias("y0"))
)
query("a14_point_density", FIX + "SELECT floor(lon / 25e-2)::BIGINT AS ix, floor(lat / 25e-2)::BIGINT AS iy, count(*)::DOUBLE AS density FROM fixes WHERE lon / 25e-2 <> floor(lon / 25e-2) AND lat / 25e-2 <> floor(lat / 25e-2) GROUP BY 1, 2")(
    lambda s, d: D.point_density(fixes(s, d), "lon", "lat", 0.25)
)
_CELLS = SEG + """, b AS (SELECT *, sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) AS len FROM segments WHERE x1 <> x2 OR y1 <> y2),
c AS (SELECT b.*, x.ix, y.iy FROM b, LATERAL (SELECT unnest(range(floor(least(x1, x2) / 25e-2)::BIGINT, floor(greatest(x1, x2) / 25e-2)::BIGINT + 1)) AS ix) x, LATERAL (SELECT unnest(range(floor(least(y1, y2) / 25e-2)::BIGINT, floor(greatest(y1, y2) / 25e-2)::BIGINT + 1)) AS iy) y),
q AS (SELECT *, greatest(0e0, CASE WHEN x2 = x1 THEN 0e0 ELSE least((ix * 25e-2 - x1) / (x2 - x1), ((ix + 1) * 25e-2 - x1) / (x2 - x1)) END, CASE WHEN y2 = y1 THEN 0e0 ELSE least((iy * 25e-2 - y1) / (y2 - y1), ((iy + 1) * 25e-2 - y1) / (y2 - y1)) END) AS t0,
  least(1e0, CASE WHEN x2 = x1 THEN 1e0 ELSE greatest((ix * 25e-2 - x1) / (x2 - x1), ((ix + 1) * 25e-2 - x1) / (x2 - x1)) END, CASE WHEN y2 = y1 THEN 1e0 ELSE greatest((iy * 25e-2 - y1) / (y2 - y1), ((iy + 1) * 25e-2 - y1) / (y2 - y1)) END) AS t1 FROM c),
cells AS (SELECT ix, iy, sum(len * (t1 - t0)) AS length, sum(timespan_seconds * (t1 - t0)) AS time FROM q WHERE t1 > t0 GROUP BY 1, 2) """
query("a14_line_density", _CELLS + "SELECT ix, iy, round(length, 4) AS density FROM cells WHERE round(length, 4) > 0")(
    lambda s, d: D.line_density(segments(s, d), 0.25).select("ix", "iy", F.round("density", 4).alias("density")).where("density > 0")
)
query("a15_time_density", _CELLS + "SELECT ix, iy, round(time / (SELECT round(sum(time), 1) FROM cells), 7) AS density FROM cells WHERE round(time / (SELECT round(sum(time), 1) FROM cells), 7) > 0")(
    lambda s, d: D.time_density(segments(s, d), 0.25).select("ix", "iy", F.round("density", 7).alias("density")).where("density > 0")
)
_LEVELS = """WITH r AS (SELECT *, sum(value) OVER (PARTITION BY event_type ORDER BY value, event_id ROWS UNBOUNDED PRECEDING) AS run, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS n, sum(value) OVER (PARTITION BY event_type) AS total FROM events),
c AS (SELECT event_type, arg_min(value, (abs(run - total * 5e-1), n)) AS c50, arg_min(value, (abs(run - total * 1e-1), n)) AS c90 FROM r GROUP BY 1) """
query("w10_percentile_levels", _LEVELS + "SELECT event_id, CASE WHEN value >= c50 THEN 50e0 WHEN value >= c90 THEN 90e0 END AS percentile FROM events JOIN c USING (event_type)")(
    lambda s, d: D.percentile_levels(_valued(s, d), "value", [50, 90], ["event_type"]).select("event_id", "percentile")
)
query("a18_percentile_area", _LEVELS + """SELECT event_type, percentile, count(*) AS cells, count(*) * 25e-1 AS area FROM (SELECT event_type, unnest(CASE WHEN value >= c50 THEN [50e0, 90e0] WHEN value >= c90 THEN [90e0] ELSE [] END) AS percentile FROM events JOIN c USING (event_type)) GROUP BY 1, 2""")(
    lambda s, d: D.percentile_area(_valued(s, d), "value", [50, 90], ["event_type"], 2.5)
)
query("a24_canvas", FIX + "SELECT least(floor((lon - 34) / 6e0 * 50), 49)::BIGINT AS px, least(floor((lat + 2) / 4e0 * 40), 39)::BIGINT AS py, count(*) AS n FROM fixes WHERE lon BETWEEN 34 AND 40 AND lat BETWEEN -2 AND 2 GROUP BY 1, 2")(
    lambda s, d: D.canvas(fixes(s, d), "lon", "lat", (34.0, -2.0, 40.0, 2.0), 50, 40)
)


def _extent(rows):
    return tuple(rows.agg(F.min("lon"), F.min("lat"), F.max("lon"), F.max("lat")).first())


def _valued(s, d):
    from faunaflow.jobs.tables import events

    return events(s, d).select("event_id", "event_type", "value")
