"""Subject tracking: fixes to trajectories to summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faunaflow.functions.times import micros
from faunaflow.jobs.tables import SQL_FIXES, SQL_SEGMENTS, fixes, sql_geodesic, sql_utm, sql_zone
from faunaflow.operators import relocations as R
from faunaflow.operators import trajectory as T

QUERIES, SQL = {}, {}
SEG = f"WITH {SQL_SEGMENTS} "
FIX = f"WITH {SQL_FIXES} "


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def standard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.standard(fixes(spark, sf_dir), "subject")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.from_fixes(standard(spark, sf_dir))


def r3(*names: str) -> list:
    return [F.round(n, 3).alias(n) for n in names]


@query("flagship_daily_movement", SEG + """
SELECT groupby_col, strftime(segment_start, '%Y-%m-%d') AS day, round(sum(dist_meters) / 1000, 3) AS km, round(sum(timespan_seconds) / 3600, 3) AS hours,
       round(avg(speed_kmhr), 3) AS mean_speed, count(*) AS segments
FROM segments WHERE NOT (dist_meters < 1e-3 OR dist_meters > 100000 OR timespan_seconds < 1 OR timespan_seconds > 172800 OR speed_kmhr < 1e-2 OR speed_kmhr > 500)
GROUP BY ALL""")
def flagship(spark, sf_dir):
    """Fixes, coordinate filter, trajectory, segment filter, and a summary by subject and day."""
    rows = R.remove_filtered(R.box_filter(standard(spark, sf_dir)))
    kept = R.remove_filtered(T.segment_filter(T.from_fixes(rows)))
    return kept.groupBy("groupby_col", F.date_format("segment_start", "yyyy-MM-dd").alias("day")).agg(
        F.round(F.sum("dist_meters") / 1000, 3).alias("km"),
        F.round(F.sum("timespan_seconds") / 3600, 3).alias("hours"),
        F.round(F.avg("speed_kmhr"), 3).alias("mean_speed"),
        F.count(F.lit(1)).alias("segments"),
    )


@query("p1_standard_fixes", FIX + "SELECT groupby_col, epoch_us(fixtime) AS t, false AS junk_status, lon, lat, event_id AS extra__event_id, event_type AS extra__event_type, value AS extra__value FROM fixes")
def p1(spark, sf_dir):
    df = standard(spark, sf_dir)
    return df.select("groupby_col", micros("fixtime").alias("t"), *df.columns[2:])


@query("p2_clean_fixes", FIX + "SELECT groupby_col, lon, lat, event_type FROM fixes WHERE NOT (lon < 35 OR lon > 38 OR lat < -1 OR lat > 1)")
def p2(spark, sf_dir):
    return R.clean(standard(spark, sf_dir), ["groupby_col", "lon", "lat", "extra__event_type"], min_x=35, max_x=38, min_y=-1, max_y=1)


@query("p3_box_filter", FIX + "SELECT event_id AS extra__event_id, lon < 35 OR lon > 38 OR lat < -1 OR lat > 1 OR (lon = 36 AND lat = 0) AS junk_status FROM fixes")
def p3(spark, sf_dir):
    return R.box_filter(standard(spark, sf_dir), min_x=35, max_x=38, min_y=-1, max_y=1, points=((36.0, 0.0),)).select("extra__event_id", "junk_status")


@query("p4_date_filter", FIX + "SELECT event_id AS extra__event_id, fixtime < TIMESTAMP '2024-01-05' OR fixtime > TIMESTAMP '2024-01-20 12:00:00' AS junk_status FROM fixes")
def p4(spark, sf_dir):
    return R.date_filter(standard(spark, sf_dir), "2024-01-05", "2024-01-20 12:00:00").select("extra__event_id", "junk_status")


@query("p5_inside_box", FIX + "SELECT event_id AS extra__event_id FROM fixes WHERE lon > 35 AND lon < 38 AND lat > -1 AND lat < 1")
def p5(spark, sf_dir):
    return R.in_box(standard(spark, sf_dir), 35, 38, -1, 1).select("extra__event_id")


@query("p6_reset_and_remove", FIX + "SELECT (SELECT count(*) FROM fixes WHERE lon >= 36) AS kept, count(*) AS all_rows FROM fixes")
def p6(spark, sf_dir):
    marked = R.mark(standard(spark, sf_dir), F.col("lon") < 36)
    kept = R.remove_filtered(marked).agg(F.count(F.lit(1)).alias("kept"))
    return kept.join(R.remove_filtered(R.reset(marked)).agg(F.count(F.lit(1)).alias("all_rows")))


@query("w1_trajectory", SEG + """SELECT groupby_col, event_id AS extra__event_id, epoch_us(segment_start) AS t0, epoch_us(segment_end) AS t1, round(timespan_seconds, 3) AS timespan_seconds,
  round(dist_meters, 2) AS dist_meters, round(speed_kmhr, 3) AS speed_kmhr, round(heading, 3) AS heading FROM segments""")
def w1(spark, sf_dir):
    return segments(spark, sf_dir).select("groupby_col", "extra__event_id", micros("segment_start").alias("t0"), micros("segment_end").alias("t1"), *r3("timespan_seconds", "speed_kmhr", "heading"), F.round("dist_meters", 2).alias("dist_meters"))


@query("p7_segment_filter", SEG + "SELECT event_id AS extra__event_id, dist_meters < 10 OR dist_meters > 8000 OR timespan_seconds < 600 OR timespan_seconds > 86400 OR speed_kmhr < 1e-1 OR speed_kmhr > 20 AS junk_status FROM segments")
def p7(spark, sf_dir):
    return T.segment_filter(segments(spark, sf_dir), (10, 8000), (600, 86400), (0.1, 20)).select("extra__event_id", "junk_status")


_NEXT = SEG + "SELECT event_id AS extra__event_id, {} AS junk_status FROM segments"


@query("w2_speed_filter", _NEXT.format("speed_kmhr > 5"))
def w2(spark, sf_dir):
    return R.speed_filter(standard(spark, sf_dir), 5).select("extra__event_id", "junk_status")


@query("w3_distance_filter", _NEXT.format("dist_meters / 1000 < 2 OR dist_meters / 1000 > 8"))
def w3(spark, sf_dir):
    return R.distance_filter(standard(spark, sf_dir), 2, 8).select("extra__event_id", "junk_status")


@query("w4_turn_angle", SEG + """SELECT event_id AS extra__event_id, round(CASE WHEN lag(heading) OVER w IS NOT NULL THEN (heading - lag(heading) OVER w + 540) - 360 * floor((heading - lag(heading) OVER w + 540) / 360) - 180 END, 3) + 0 AS turn_angle
FROM segments WINDOW w AS (PARTITION BY groupby_col ORDER BY segment_start)""")
def w4(spark, sf_dir):
    return T.turn_angles(segments(spark, sf_dir)).select("extra__event_id", (F.round("turn_angle", 3) + 0).alias("turn_angle"))


@query("w5_net_squared_displacement", SEG + "SELECT event_id AS extra__event_id, round(nsd, 3) AS nsd FROM segments")
def w5(spark, sf_dir):
    return segments(spark, sf_dir).select("extra__event_id", *r3("nsd"))


@query("w6_upsample", FIX + """, z AS (SELECT groupby_col, epoch_us(min(fixtime)) AS zero, epoch_us(max(fixtime)) AS top, count(*) AS n FROM fixes GROUP BY 1),
ticks AS (SELECT groupby_col, zero + k * 21600000000 AS t FROM (SELECT *, unnest(range(0, (top - zero) // 21600000000 + 1)) AS k FROM z WHERE n > 1)),
near AS (SELECT t.groupby_col, t.t, max(epoch_us(f.fixtime)) AS s FROM ticks t JOIN fixes f ON f.groupby_col = t.groupby_col AND epoch_us(f.fixtime) <= t.t GROUP BY 1, 2),
pts AS (SELECT groupby_col, epoch_us(fixtime) AS s, lon, lat, lead(epoch_us(fixtime)) OVER w AS e, lead(lon) OVER w AS x2, lead(lat) OVER w AS y2 FROM fixes WINDOW w AS (PARTITION BY groupby_col ORDER BY fixtime))
SELECT groupby_col, t, round(CASE WHEN e IS NULL THEN lon ELSE lon + (t - s) / (e - s) * (x2 - lon) END, 6) AS lon, round(CASE WHEN e IS NULL THEN lat ELSE lat + (t - s) / (e - s) * (y2 - lat) END, 6) AS lat
FROM near JOIN pts USING (groupby_col, s)""")
def w6(spark, sf_dir):
    return T.upsample(segments(spark, sf_dir), 21600).select("groupby_col", micros("fixtime").alias("t"), F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


@query("w7_downsample", FIX + """, o AS (SELECT *, epoch_us(fixtime) AS t, row_number() OVER (PARTITION BY groupby_col ORDER BY fixtime) AS n FROM fixes),
nxt AS (SELECT a.groupby_col, a.n, min(b.n) AS m FROM o a JOIN o b ON a.groupby_col = b.groupby_col AND b.n > a.n AND b.t >= a.t + 82800000000 GROUP BY 1, 2),
walk AS (WITH RECURSIVE r(groupby_col, n, burst) AS (SELECT DISTINCT groupby_col, 1::BIGINT, 0::BIGINT FROM o UNION ALL
  SELECT r.groupby_col, x.m, r.burst + (b.t > a.t + 90000000000)::BIGINT FROM r JOIN nxt x USING (groupby_col, n) JOIN o a USING (groupby_col, n) JOIN o b ON b.groupby_col = r.groupby_col AND b.n = x.m) SELECT * FROM r)
SELECT groupby_col, t, burst AS extra__burst FROM walk JOIN nxt USING (groupby_col, n) JOIN o USING (groupby_col, n)""")
def w7(spark, sf_dir):
    return T.downsample(standard(spark, sf_dir), 86400, 3600).select("groupby_col", micros("fixtime").alias("t"), "extra__burst")


@query("w8_to_fixes", FIX + "SELECT groupby_col, epoch_us(fixtime) AS t, lon, lat FROM fixes WHERE groupby_col IN (SELECT groupby_col FROM fixes GROUP BY 1 HAVING count(*) > 1)")
def w8(spark, sf_dir):
    return T.to_fixes(segments(spark, sf_dir)).select("groupby_col", micros("fixtime").alias("t"), "lon", "lat")


@query("w11_speed_steps", SEG + """SELECT groupby_col, place, epoch_us(CASE WHEN place < 2 THEN segment_start ELSE segment_end END) AS t, round(CASE WHEN place IN (1, 2) THEN speed_kmhr ELSE 0 END, 3) AS speed
FROM segments, (SELECT unnest([0, 1, 2, 3])::INTEGER AS place)""")
def w11(spark, sf_dir):
    return T.speed_steps(segments(spark, sf_dir)).select("groupby_col", "place", micros("time").alias("t"), *r3("speed"))


_ENDS = "(SELECT groupby_col, arg_min(x1, segment_start) AS ax, arg_min(y1, segment_start) AS ay, arg_max(x2, segment_start) AS ex, arg_max(y2, segment_start) AS ey, sum(dist_meters) AS path FROM segments GROUP BY 1)"


@query("a19_displacement", SEG + f"SELECT groupby_col, round(d, 3) AS displacement, round(path / nullif(d, 0), 3) AS tortuosity FROM {sql_geodesic(_ENDS, 'ax', 'ay', 'ex', 'ey', 'd', 'az')}")
def a19(spark, sf_dir):
    return T.displacement(segments(spark, sf_dir)).select("groupby_col", *r3("displacement", "tortuosity"))


_CENTRED = FIX + f""", m AS (SELECT groupby_col, {sql_zone('avg(lon)', 'avg(lat)')} AS zone FROM fixes GROUP BY 1), z AS (SELECT * FROM fixes JOIN m USING (groupby_col)), u AS (SELECT * FROM {sql_utm('z', 'lon', 'lat', 'zone')}),
c AS (SELECT groupby_col, avg(x) AS cx, avg(y) AS cy FROM (SELECT DISTINCT groupby_col, x, y FROM u) GROUP BY 1), e AS (SELECT u.*, sqrt((x - cx) ** 2 + (y - cy) ** 2) AS far FROM u JOIN c USING (groupby_col)) """


@query("a20_cluster_stats", _CENTRED + "SELECT groupby_col, count(*) FILTER (far <= 5000) AS points_within, round(max(far), 3) AS cluster_radius, round(stddev_pop(far), 3) AS cluster_std_dev FROM e GROUP BY 1")
def a20(spark, sf_dir):
    return R.cluster_stats(standard(spark, sf_dir), 5000).select("groupby_col", "points_within", *r3("cluster_radius", "cluster_std_dev"))


@query("a21_immobility", _CENTRED + """, s AS (SELECT groupby_col, count(*) AS n, avg((far <= 5000)::INT) AS share, (epoch_us(max(fixtime)) - epoch_us(min(fixtime))) / 1e6 AS timespan FROM e GROUP BY 1)
SELECT groupby_col, CASE WHEN timespan < 18000 THEN 'insufficient' WHEN share >= 8e-1 AND timespan > 18000 THEN 'immobile' ELSE 'mobile' END AS status, n, round(share, 3) AS share, round(timespan, 3) AS timespan FROM s""")
def a21(spark, sf_dir):
    return R.immobility(standard(spark, sf_dir), radius=5000).select("groupby_col", "status", "n", *r3("share", "timespan"))
