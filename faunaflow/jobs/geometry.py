"""Projections, geometry columns, file forms, home ranges."""

from __future__ import annotations

from pyspark.sql import functions as F

from faunaflow.functions import geodesy as G
from faunaflow.functions.stages import written
from faunaflow.jobs.mapping import _CELLS
from faunaflow.jobs.tables import SQL_FIXES, SQL_SEGMENTS, events, fixes, regions, sql_utm, sql_zone
from faunaflow.jobs.tracking import segments, standard
from faunaflow.operators import classify as C
from faunaflow.operators import density as D
from faunaflow.operators import ranges as R
from faunaflow.operators import relocations as L
from faunaflow.operators import spatial as P
from faunaflow.operators import summary as S
from faunaflow.sources import tables as T

QUERIES, SQL = {}, {}
FIX, SEG = f"WITH {SQL_FIXES} ", f"WITH {SQL_SEGMENTS} "


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("g3_mercator", FIX + "SELECT event_id, round(radians(lon) * 6378137e0, 2) AS x, round(ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137e0, 2) + 0 AS y FROM fixes")
def g3(s, d):
    x, y = G.mercator(F.col("lon"), F.col("lat"))
    return fixes(s, d).select(F.col("extra__event_id").alias("event_id"), F.round(x, 2).alias("x"), (F.round(y, 2) + 0).alias("y"))


@query("g3_utm", FIX + f", z AS (SELECT *, {sql_zone('lon', 'lat')} AS zone FROM fixes) SELECT event_id, round(x, 2) AS x, round(y, 2) + 0 AS y FROM {sql_utm('z', 'lon', 'lat', 'zone')}")
def g3_utm(s, d):
    x, y = G.utm(F.col("lon"), F.col("lat"), G.utm_zone(F.col("lon"), F.col("lat")))
    return fixes(s, d).select(F.col("extra__event_id").alias("event_id"), F.round(x, 2).alias("x"), (F.round(y, 2) + 0).alias("y"))


@query("g5_geometry_column", FIX + "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE round(CASE WHEN event_id % 2 = 0 THEN lon ELSE lon + 5e-1 END, 6) END AS lon, CASE WHEN event_id % 5 = 0 THEN NULL ELSE round(CASE WHEN event_id % 2 = 0 THEN lat ELSE lat + 5e-1 END, 6) END AS lat FROM fixes")
def g5(s, d):
    n, e = F.format_string, F.col("extra__event_id")
    ring = ", ".join(["[%f, %f]"] * 5)
    a, b = F.col("lon"), F.col("lat")
    poly = n('{"type":"Polygon","coordinates":[[' + ring + "]]}", a, b, a + 1, b, a + 1, b + 1, a, b + 1, a, b)
    text = F.when(e % 5 == 0, "{bad").when(e % 2 == 0, n('{"type":"Point","coordinates":[%f, %f]}', a, b)).otherwise(poly)
    g = fixes(s, d).select(e.alias("event_id"), text.alias("j")).select("event_id", T.geometry_of("j").alias("g"))
    return g.select("event_id", F.round("g.lon", 6).alias("lon"), F.round("g.lat", 6).alias("lat"))


query("g7_grid_path", SEG + """, cuts AS (SELECT *, list_sort(list_distinct([0e0, 1e0] || list_filter(
  list_transform(range(ceil(least(x1, x2) / 1e-1)::BIGINT, floor(greatest(x1, x2) / 1e-1)::BIGINT + 1), lambda k: (k * 1e-1 - x1) / nullif(x2 - x1, 0))
  || list_transform(range(ceil(least(y1, y2) / 1e-1)::BIGINT, floor(greatest(y1, y2) / 1e-1)::BIGINT + 1), lambda k: (k * 1e-1 - y1) / nullif(y2 - y1, 0)), lambda t: t > 0 AND t < 1))) AS ts FROM segments),
parts AS (SELECT *, unnest(range(1, len(ts))) AS k FROM cuts), each AS (SELECT *, ts[k + 1] - ts[k] AS share, (ts[k + 1] + ts[k]) / 2 AS mid FROM parts)
SELECT event_id, floor((x1 + mid * (x2 - x1)) / 1e-1)::BIGINT AS ix, floor((y1 + mid * (y2 - y1)) / 1e-1)::BIGINT AS iy, round(share, 9) AS share FROM each""")(
    lambda s, d: P.grid_traversal(segments(s, d), "x1", "y1", "x2", "y2", 0.1).select(F.col("extra__event_id").alias("event_id"), "ix", "iy", F.round("share", 9).alias("share"))
)
query("g1_inverse", SEG + "SELECT round(sum(dist_meters) / 1000, 3) AS km, round(max(dist_meters), 2) AS longest, count(*) AS n FROM segments")(
    lambda s, d: segments(s, d).agg(F.round(F.sum("dist_meters") / 1000, 3).alias("km"), F.round(F.max("dist_meters"), 2).alias("longest"), F.count(F.lit(1)).alias("n"))
)
query("s1_locations", FIX + "SELECT event_id, lon, lat FROM fixes")(
    lambda s, d: T.placed(fixes(s, d).select(F.col("extra__event_id").alias("event_id"), F.struct(F.col("lon").alias("longitude"), F.col("lat").alias("latitude")).alias("location")))
)
query("s3_regions", "SELECT n_name AS name, sha256(n_name) AS pk FROM nation WHERE n_nationkey < 20")(
    lambda s, d: T.load_regions(regions(s, d).withColumn("geom_type", F.when(F.col("pk") < 20, "Polygon").otherwise("Point")), "name").select("name", "pk")
)
query("s5_key_hash", """SELECT event_type, substr(sha256('{"event_type": "' || event_type || '", "year": "2024"}'), 1, 6) AS key_hash, count(*) AS n FROM events GROUP BY 1, 2""")(
    lambda s, d: events(s, d).withColumn("year", F.lit("2024")).withColumn("key_hash", T.key_hash({"year": "year", "event_type": "event_type"})).groupBy("event_type", "key_hash").agg(F.count(F.lit(1)).alias("n"))
)
query("s6_content_hash")(lambda s, d: T.content_hash(events(s, d)))
query("s7_plain_columns", "SELECT event_id, '[' || event_id || ',1]' AS a, event_type AS b, user_id::VARCHAR AS c FROM events")(
    lambda s, d: T.plain_columns(events(s, d).select("event_id", F.array(F.col("event_id"), F.lit(1)).alias("a"), F.encode("event_type", "UTF-8").alias("b"), F.col("user_id").alias("c")), ["c"])
)
query("s4_geojson", FIX + "SELECT event_id, lon, lat FROM fixes")(
    lambda s, d: T.geojson_lines(fixes(s, d).select("lon", "lat", F.col("extra__event_id").alias("event_id"))).select(
        F.get_json_object("value", "$.properties.event_id").cast("long").alias("event_id"), F.get_json_object("value", "$.geometry.coordinates[0]").cast("double").alias("lon"), F.get_json_object("value", "$.geometry.coordinates[1]").cast("double").alias("lat")
    )
)
query("s8_map_ready", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts FROM events WHERE event_id % 3 <> 0")(
    lambda s, d: T.map_ready(events(s, d).select("event_id", "ts", F.when(F.col("event_id") % 3 != 0, 1.0).alias("lon"), F.lit(2.0).alias("lat"))).select("event_id", "ts")
)
query("p10_geometry_kind", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'Point' ELSE 'LineString' END AS kind FROM events")(
    lambda s, d: events(s, d).select("event_id", F.unhex(F.when(F.col("event_id") % 2 == 0, "0101000000").otherwise("0000000002")).alias("w")).select("event_id", T.geometry_kind("w").alias("kind")).where(F.col("kind").isin("Point", "LineString"))
)


@query("x1_user_reducer", "SELECT event_type, round(max(value) - min(value), 6) AS spread FROM events GROUP BY 1")
def x1(s, d):
    def spread(rows):
        return rows.groupby("event_type", as_index=False)["value"].agg(lambda v: v.max() - v.min()).rename(columns={"value": "spread"})

    return T.reduced(events(s, d).select("event_type", "value"), "event_type", spread, "event_type string, spread double").withColumn("spread", F.round("spread", 6))


query("x2_user_chunks", "SELECT event_id, round(value * 2, 6) AS twice FROM events")(
    lambda s, d: T.chunked(events(s, d).select("event_id", "value"), lambda p: p.assign(twice=p["value"] * 2)[["event_id", "twice"]], "event_id long, twice double").withColumn("twice", F.round("twice", 6))
)
query("a17_track_density", _CELLS + ", t AS (SELECT ix, iy, time / 3600 AS h FROM cells), lim AS (SELECT min(h) AS l, max(h) AS m FROM t) SELECT ix, iy, greatest(1, ceil(round((h - l) / (m - l) * 10, 9)))::INT AS class FROM t, lim WHERE round(h, 7) > 0")(
    lambda s, d: _classed_tracks(s, d)
)


def _classed_tracks(s, d):
    cells = D.line_density(segments(s, d), 0.25, "timespan_seconds").withColumn("h", F.col("density") / 3600)
    return C.classify(cells, "h", "class", C.breaks(cells, "h", "equal_interval", k=10), labels=list(range(1, 11))).where("round(h, 7) > 0").select("ix", "iy", "class")


def _metric_segments(s, d):
    at = lambda a, b: G.mercator(F.col(a), F.col(b))
    (x1, y1), (x2, y2) = at("x1", "y1"), at("x2", "y2")
    return segments(s, d).withColumns({"mx1": x1, "my1": y1, "mx2": x2, "my2": y2}).select("groupby_col", "timespan_seconds", "speed_kmhr", *[F.col(f"m{c}").alias(c) for c in ("x1", "y1", "x2", "y2")])


@query("a16_elliptical_density")
def a16(s, d):
    rows = written(_metric_segments(s, d).drop("groupby_col"))
    fit = R.weibull_fit(rows, "speed_kmhr")
    if fit is None:
        return s.createDataFrame([], "ix long, iy long, density double")
    shape, scale = fit
    top, *box = rows.agg(F.max("speed_kmhr"), *[f(g(f"{k}1", f"{k}2")) for f, g in ((F.min, F.least), (F.max, F.greatest)) for k in "xy"]).first()
    # a largest speed below an observed one would leave that segment without cells
    fastest = max(R.weibull_quantile(0.9999, shape, scale), 1.05 * top)
    dx, dy = 0.15 * (box[2] - box[0]), 0.15 * (box[3] - box[1])
    near = R.elliptical_density(rows, 2500.0, fastest, shape, scale, extent=(box[0] - dx, box[1] - dy, box[2] + dx, box[3] + dy))
    return near.select("ix", "iy", F.round("density", 6).alias("density"))


@query("g8_weibull")
def g8(s, d):
    fit = R.weibull_fit(segments(s, d), "speed_kmhr")
    return s.createDataFrame([fit] if fit else [], "shape double, scale double").select(F.round("shape", 4).alias("shape"), F.round("scale", 4).alias("scale"))


query("a26_hull_growth")(lambda s, d: R.hull_growth(L.projected(standard(s, d)).withColumn("day", F.to_date("fixtime"))).select("groupby_col", "day", F.round("area_km2", 3).alias("area_km2")))
query("a4_merged_coverage")(lambda s, d: S.coverage_cells(_metric_segments(s, d), 2000.0, 500.0).agg(F.count(F.lit(1)).alias("cells"), (F.count(F.lit(1)) * 0.25).alias("area_km2")))

query("a4_merged_area")(lambda s, d: S.coverage_area(_metric_segments(s, d), 2000.0, ["groupby_col"]).select("groupby_col", F.round("area_km2", 3).alias("area_km2")))
