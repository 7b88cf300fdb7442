"""Schemas with defaults, written files, times and zones, legends, ramps and classes of utilisation."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from faunaflow.functions.stages import shared_dir
from faunaflow.functions.sun import night_fraction
from faunaflow.functions.times import micros
from faunaflow.jobs.mapping import _CELLS
from faunaflow.jobs.tables import SQL_FIXES, SQL_SEGMENTS, events, fixes, sql_geodesic
from faunaflow.jobs.tracking import segments, standard
from faunaflow.operators import classify as C
from faunaflow.operators import density as D
from faunaflow.operators import schemas as H
from faunaflow.operators import spatial as P
from faunaflow.operators import timekeys as K
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


# schemas


@query("p19_patrol_fixes", FIX + """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'None' ELSE (event_id % 100)::VARCHAR END AS patrol_serial_number, coalesce(CASE WHEN event_id % 3 <> 0 THEN event_type END, 'None') AS patrol_status,
  'None' AS patrol_subject, event_type AS patrol_type__value FROM fixes""")
def p19_patrol_fixes(s, d):
    e = F.col("extra__event_id")
    df = standard(s, d).withColumns({"patrol_serial_number": F.when(e % 4 != 0, (e % 100).cast("double")), "patrol_status": F.when(e % 3 != 0, F.col("extra__event_type")), "patrol_type__value": F.col("extra__event_type")})
    return H.validated(df, H.PATROL_FIXES).select(e.alias("event_id"), *H.PATROL_FIXES.defaults)


@query("p19_event_defaults", "SELECT event_id, 'None' AS event_category, CASE WHEN event_id % 5 = 0 THEN 'None' ELSE 'U' || user_id END AS reporter FROM events")
def p19_events(s, d):
    name = F.when(F.col("event_id") % 5 != 0, F.struct(F.concat(F.lit("U"), F.col("user_id")).alias("name"), F.col("user_id").alias("id")))
    df = events(s, d).select("event_id", "event_type", F.col("ts").alias("time"), name.alias("reported_by"), F.lit(None).cast("double").alias("lon"), F.lit(None).cast("double").alias("lat"))
    return H.validated(df, H.EVENTS).select("event_id", "event_category", F.col("reported_by.name").alias("reporter"))


@query("p19_problems", """SELECT 'fixtime' AS column, 'missing values' AS problem, count(*) FILTER (event_id % 9 = 0) AS rows FROM events UNION ALL SELECT 'lat', 'missing values', count(*) FILTER (event_id % 4 = 0) FROM events
UNION ALL SELECT 'junk_status', 'absent', NULL UNION ALL SELECT 'groupby_col', 'type bigint', NULL""")
def p19_problems(s, d):
    e = F.col("extra__event_id")
    df = fixes(s, d).select(F.col("subject").cast("long").alias("groupby_col"), F.when(e % 9 != 0, F.col("fixtime")).alias("fixtime"), "lon", F.when(e % 4 == 0, float("nan")).otherwise(F.col("lat")).alias("lat"))
    return H.problems(df, H.RELOCATIONS)


# densities

query("a17_utilisation", _CELLS + """, dens AS (SELECT ix, iy, time / (SELECT round(sum(time), 1) FROM cells) AS v FROM cells WHERE time <> 0),
runs AS (SELECT *, sum(v) OVER (ORDER BY v, ix, iy ROWS UNBOUNDED PRECEDING) AS run, row_number() OVER (ORDER BY v, ix, iy) AS n, sum(v) OVER () AS total FROM dens), lev AS (SELECT unnest([50e0, 60e0, 70e0, 80e0, 90e0, 100e0]) AS p),
cuts AS (SELECT p, arg_min(v, (abs(run - total * (1 - p / 100)), n)) AS cut FROM runs, lev GROUP BY 1), kept AS (SELECT ix, iy, min(p) AS percentile FROM dens JOIN cuts ON v >= cut GROUP BY 1, 2)
SELECT percentile, percentile AS density, percentile || ' %' AS density_bins, count(*) AS cells, count(*) * 625e-4 AS area FROM kept GROUP BY 1""")(lambda s, d: D.classed_utilisation(segments(s, d), 0.25))
query("a24_lines", SEG + """, p AS (SELECT event_id, (x1 - 34) / 6e0 * 50 AS x1, (x2 - 34) / 6e0 * 50 AS x2, (y1 + 2) / 4e0 * 40 AS y1, (y2 + 2) / 4e0 * 40 AS y2 FROM segments),
cuts AS (SELECT *, list_sort(list_distinct([0e0, 1e0] || list_filter(
  list_transform(range(ceil(least(x1, x2))::BIGINT, floor(greatest(x1, x2))::BIGINT + 1), lambda k: (k - x1) / nullif(x2 - x1, 0)) || list_transform(range(ceil(least(y1, y2))::BIGINT, floor(greatest(y1, y2))::BIGINT + 1), lambda k: (k - y1) / nullif(y2 - y1, 0)),
  lambda t: t > 0 AND t < 1))) AS ts FROM p), parts AS (SELECT *, unnest(range(1, len(ts))) AS k FROM cuts), each AS (SELECT *, (ts[k + 1] + ts[k]) / 2 AS mid, ts[k + 1] - ts[k] AS share FROM parts),
seen AS (SELECT event_id, floor(x1 + mid * (x2 - x1))::BIGINT AS px, floor(y1 + mid * (y2 - y1))::BIGINT AS py FROM each WHERE share > 1e-9 GROUP BY ALL) SELECT px, py, count(*) AS n FROM seen WHERE px BETWEEN 0 AND 49 AND py BETWEEN 0 AND 39 GROUP BY 1, 2""")(
    lambda s, d: D.line_canvas(segments(s, d), (34.0, -2.0, 40.0, 2.0), 50, 40)
)
query("a23_grid_size", FIX + ", b AS (SELECT min(lon) AS x0, min(lat) AS y0, max(lon) AS x1, max(lat) AS y1 FROM fixes) SELECT greatest(1, round_even(dist / 100, 0)::BIGINT) AS size FROM " + sql_geodesic("b", "x0", "y0", "x1", "y1", "dist", "azimuth"))(
    lambda s, d: P.grid_size(fixes(s, d))
)

# colours and legends

query("f16_colour_ramp", """WITH m AS (SELECT event_id, CASE WHEN event_id % 6 <> 0 THEN value END AS v FROM events), l AS (SELECT min(v) AS low, max(v) AS high FROM m), s AS (SELECT event_id, CASE WHEN v IS NOT NULL THEN least(floor((v - low) / (high - low) * 256), 255) END AS k FROM m, l)
SELECT event_id, CASE WHEN k IS NULL THEN 0 WHEN k < 128 THEN round_even(k * 2 / 255 * 255, 0) ELSE 255 END::INT AS red, CASE WHEN k IS NULL THEN 0 WHEN k >= 128 THEN round_even((2 - k * 2 / 255) * 255, 0) ELSE 255 END::INT AS blue, CASE WHEN k IS NULL THEN 0 ELSE 255 END AS alpha FROM s""")(
    lambda s, d: C.colour_ramp(events(s, d).select("event_id", F.when(F.col("event_id") % 6 != 0, F.col("value")).alias("v")), "v", "c", C.RAMPS["bwr"]).select("event_id", F.col("c")[0].alias("red"), F.col("c")[2].alias("blue"), F.col("c")[3].alias("alpha"))
)
query("a22_legend", """SELECT (user_id % 12) || ' km' AS label, printf('rgba(%d, 7, 9, 1.0)', (arg_min(event_id, event_id) % 200)::INT) AS colour FROM events GROUP BY user_id % 12""")(
    lambda s, d: C.legend(events(s, d).select("event_id", (F.col("user_id") % 12).alias("n"), F.array((F.col("event_id") % 200).cast("int"), F.lit(7), F.lit(9), F.lit(255)).alias("rgba")), "n", "rgba", "ascending", " km", ["event_id"])
)
query("a22_months", "SELECT DISTINCT strftime(o_orderdate, '%B') AS choice, month(o_orderdate) AS place FROM orders")(
    lambda s, d: K.choices(s.read.parquet(f"{d}/orders.parquet"), "o_orderdate", "%B")
)

# times

query("t1_clean_times", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN epoch_us(ts) // 1000000 - 10800 WHEN 2 THEN epoch_us(ts) // 1000000 ELSE epoch_us(date_trunc('day', ts)) // 1000000 END AS t FROM events")(
    lambda s, d: K.clean_times(events(s, d).select("event_id", F.when(F.col("event_id") % 4 == 0, "no time").when(F.col("event_id") % 4 == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+03:00'")).when(F.col("event_id") % 4 == 2, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("recorded_at"))).select("event_id", F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', recorded_at)").alias("t"))
)
query("t2_local_times", "SELECT event_id, strftime(ts + INTERVAL 3 HOUR, '%Y-%m-%d %H:%M:%S') AS moment, strftime(ts, '%Y-%m-%d %H:%M:%S') AS plain FROM events")(
    lambda s, d: K.to_zone(events(s, d).select("event_id", F.timestamp_micros(micros("ts")).alias("moment"), F.col("ts").alias("plain")), "Africa/Nairobi", auto_detect=True).select("event_id", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("moment", "plain")])
)
query("t9_night_fraction", SEG + """SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN round(greatest(least(e, dawn) - greatest(s, dusk), 0) / nullif(e - s, 0), 6) END AS night FROM (SELECT event_id, epoch_us(segment_start) AS s, epoch_us(segment_end) AS e,
  epoch_us(date_trunc('day', segment_start) + INTERVAL 18 HOUR) AS dusk, epoch_us(date_trunc('day', segment_start) + INTERVAL 30 HOUR) AS dawn FROM segments)""")(
    lambda s, d: segments(s, d).select(F.col("extra__event_id").alias("event_id"), micros("segment_start").alias("s"), micros("segment_end").alias("e"), micros("date_trunc('day', segment_start)").alias("day")).select(
        "event_id", F.round(night_fraction(F.when(F.col("event_id") % 5 != 0, F.col("day") + 64_800_000_000), F.col("day") + 108_000_000_000, F.col("s"), F.col("e")), 6).alias("night")
    )
)

# files and geometry


def _path(s) -> str:
    return f"{shared_dir(s)}/faunaflow-{uuid.uuid4().hex}"


@query("s4_written_features", FIX + "SELECT event_id, event_type, lon, lat FROM fixes")
def s4_written(s, d):
    """Written as GeoJSON and read back."""
    path = _path(s)
    T.persist(fixes(s, d).select("lon", "lat", F.col("extra__event_id").alias("event_id"), F.col("extra__event_type").alias("event_type")), path, "geojson")
    lon, lat = T.point_of("coordinates")
    return T.read_feature_lines(s, path, "event_id:long, event_type:string").select("event_id", "event_type", lon.alias("lon"), lat.alias("lat"))


@query("s4_written_csv", "SELECT event_id, event_type, props FROM events")
def s4_csv(s, d):
    """Written as CSV and read back; the texts hold quotes and commas."""
    path = _path(s)
    T.persist(events(s, d).select("event_id", "event_type", "props"), path, "csv")
    return s.read.schema("event_id long, event_type string, props string").csv(path, header=True, escape="\\")


@query("s5_group_files", """SELECT event_type, substr(sha256('{"event_type": "' || event_type || '", "user": "' || user_id % 5 || '"}'), 1, 6) AS key_hash, count(*) AS n, round(sum(value), 2) AS total FROM events WHERE event_type <> 'view' GROUP BY event_type, user_id % 5""")
def s5_files(s, d):
    """One folder for each group, named by its key, written and read back; rows without a key are in none."""
    path = _path(s)
    df = events(s, d).select("event_id", "value", F.when(F.col("event_type") != "view", F.col("event_type")).alias("event_type"), (F.col("user_id") % 5).cast("string").alias("user"))
    T.persist_groups(df, {"event_type": "event_type", "user": "user"}, path)
    back = s.read.schema("event_id long, value double, event_type string, user string, key_hash string").parquet(path)
    return back.groupBy("event_type", "key_hash").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("s2_features", FIX + "SELECT event_id, 'Point' AS geom_type, lon, lat FROM fixes")
def s2_features(s, d):
    """Feature collections of a day each, written as files and read back."""
    path = _path(s)
    lines = T.geojson_lines(fixes(s, d).select("lon", "lat", F.col("extra__event_id").alias("event_id")))
    lines.select(F.concat(F.lit('{"type":"FeatureCollection","features":['), "value", F.lit("]}")).alias("value")).write.text(path, lineSep="\n")
    lon, lat = T.point_of("coordinates")
    return T.read_features(s, path, "event_id:long", lines=True).select("event_id", "geom_type", lon.alias("lon"), lat.alias("lat"))


@query("g6_track_vertices", SEG + """SELECT event_id, round(x1, 6) AS lon, round(y1, 6) AS lat, epoch_us(segment_start) // 1000000 AS t FROM segments UNION ALL SELECT event_id, round(x2, 6), round(y2, 6), epoch_us(segment_end) // 1000000 FROM segments WHERE event_id % 2 = 0""")
def g6(s, d):
    e, at = F.col("extra__event_id"), lambda c: (micros(c) / 1000).cast("long")
    line = F.format_string('{"type":"LineString","coordinates":[[%.6f,%.6f,%d],[%.6f,%.6f,%d]]}', "x1", "y1", at("segment_start"), "x2", "y2", at("segment_end"))
    lines = F.format_string('{"type":"MultiLineString","coordinates":[[[%.6f,%.6f,%d],[%.6f,%.6f]]]}', "x1", "y1", at("segment_start"), "x2", "y2")
    df = segments(s, d).select(e.alias("patrol_id"), F.when(e % 2 == 0, line).otherwise(lines).alias("geometry"))
    return T.track_vertices(df, "geometry", "patrol_id", "event_id").select("event_id", "lon", "lat", F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', fixtime)").alias("t"))


@query("p14_force_points", FIX + """SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'Point' WHEN 1 THEN 'Polygon' ELSE 'MultiPolygon' END AS geom_type, round(lon + CASE event_id % 3 WHEN 0 THEN 0e0 WHEN 1 THEN 1e0 ELSE 27e-1 END, 5) AS lon,
  round(lat + CASE event_id % 3 WHEN 0 THEN 0e0 WHEN 1 THEN 5e-1 ELSE 1e0 - 1e-1 END, 5) AS lat FROM fixes""")
def p14_points(s, d):
    """A point, a rectangle of 2 by 1, or a square of 4 by 2 whose centre is (3, 1) with one of 2 by 1 whose centre is (1.5, 0.5)."""
    box = lambda x, y, w, h: (F.col("lon") + x, F.col("lat") + y, F.col("lon") + x + w, F.col("lat") + y + h)
    ring = "[[%.7f,%.7f],[%.7f,%.7f],[%.7f,%.7f],[%.7f,%.7f],[%.7f,%.7f]]"
    corners = lambda a, b, c, e: (a, b, c, b, c, e, a, e, a, b)
    one, two = corners(*box(0, 0, 2, 1)), (*corners(*box(1, 0, 4, 2)), *corners(*box(0.5, 0, 2, 1)))
    e = F.col("extra__event_id")
    text = (
        F.when(e % 3 == 0, F.format_string('{"type":"Point","coordinates":[%.7f,%.7f]}', "lon", "lat"))
        .when(e % 3 == 1, F.format_string('{"type":"Polygon","coordinates":[' + ring + "]}", *one))
        .otherwise(F.format_string('{"type":"MultiPolygon","coordinates":[[' + ring + "],[" + ring + "]]}", *two))
    )
    got = T.with_points(fixes(s, d).select(e.alias("event_id"), text.alias("geometry")))
    return got.select("event_id", "geom_type", F.round("lon", 5).alias("lon"), F.round("lat", 5).alias("lat"))
