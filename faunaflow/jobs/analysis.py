"""Sun, seasons, images and classes."""

from __future__ import annotations

from pyspark.sql import functions as F

from faunaflow.functions import sun as U
from faunaflow.functions.times import micros
from faunaflow.jobs.tables import SQL_FIXES, SQL_SEGMENTS, events, fixes, regions
from faunaflow.jobs.tracking import segments
from faunaflow.operators import classify as C
from faunaflow.operators import seasons as S

QUERIES, SQL = {}, {}
SEG, FIX = f"WITH {SQL_SEGMENTS} ", f"WITH {SQL_FIXES} "


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


_ALT = """, a AS (SELECT *, (epoch_us(fixtime) - 946728000000000) / 86400000000 AS days FROM fixes), b AS (SELECT *, radians(357529e-3 + 98560028e-8 * days) AS g FROM a),
c AS (SELECT *, radians(280459e-3 + 98564736e-8 * days + 1915e-3 * sin(g) + 20e-3 * sin(2 * g)) AS l, radians(23439e-3 - 36e-8 * days) AS e FROM b),
s AS (SELECT *, degrees(asin(sin(radians(lat)) * sin(asin(sin(e) * sin(l))) + cos(radians(lat)) * cos(asin(sin(e) * sin(l))) * cos(radians(28046061837e-8 + 36098564736629e-11 * days + lon) - atan2(cos(e) * sin(l), cos(l))))) AS alt FROM c) """
query("t7_sun", FIX + _ALT + "SELECT event_id, round(alt, 4) + 0 AS altitude, alt < 0 AS night FROM s")(
    lambda s, d: fixes(s, d).select(F.col("extra__event_id").alias("event_id"), (F.round(U.altitude(micros("fixtime"), F.col("lon"), F.col("lat")), 4) + 0).alias("altitude"), U.is_night("fixtime", "lon", "lat").alias("night"))
)


def _edge(source: str, noon: str, side: int, out: str, horizon: int) -> str:
    """A subquery that adds the crossing of an altitude in degrees, in microseconds, before or after a mean noon; needs day, lon and lat."""
    steps = [
        {"n_guess": f"({noon}) + {side} * 21600000000e0"},
        {"n_days": "(n_guess - 946728000000000) / 86400000000e0"},
        {"n_g": "radians(357.529e0 + 0.98560028e0 * n_days)", "n_q": "280.459e0 + 0.98564736e0 * n_days", "n_e": "radians(23.439e0 - 0.00000036e0 * n_days)"},
        {"n_l": "radians(n_q + 1.915e0 * sin(n_g) + 0.020e0 * sin(2 * n_g))"},
        {"n_dec": "asin(sin(n_e) * sin(n_l))", "n_late": "degrees(atan2(cos(n_e) * sin(n_l), cos(n_l))) - n_q + 180"},
        {"n_cos": f"(sin(radians({horizon})) - sin(radians(lat)) * sin(n_dec)) / (cos(radians(lat)) * cos(n_dec))", "n_eq": "(n_late - 360 * floor(n_late / 360) - 180) / 15 * 3600000000e0"},
        {out: f"({noon}) + n_eq + {side} * CASE WHEN n_cos BETWEEN -1 AND 1 THEN degrees(acos(n_cos)) END / 15 * 3600000000e0"},
    ]
    for step in steps:
        source = f"(SELECT *, {', '.join(f'{e} AS {n}' for n, e in step.items())} FROM {source})"
    return f"(SELECT * EXCLUDE ({', '.join(n for step in steps[:-1] for n in step)}) FROM {source})"


_NOON = "(day + {}) * 86400000000e0 + 43200000000e0 - lon / 15 * 3600000000e0"


def _nights(source: str, horizon: int) -> str:
    """A subquery that adds dusk of a solar day and the dawn after it."""
    return _edge(_edge(source, _NOON.format(0), 1, "dusk", horizon), _NOON.format(1), -1, "dawn", horizon)



@query("t8_night_window", FIX + f""", f AS (SELECT groupby_col AS subject, epoch_us(date_trunc('day', fixtime)) // 86400000000 AS day, arg_min(lon, fixtime) AS lon, arg_min(lat, fixtime) AS lat FROM fixes GROUP BY 1, 2)
SELECT subject, day, round(dusk / 1e6)::BIGINT AS dusk, round(dawn / 1e6)::BIGINT AS dawn FROM {_nights('f', -6)}""")
def t8(s, d):
    days = fixes(s, d).groupBy("subject", F.unix_date(F.to_date("fixtime")).alias("day")).agg(F.min_by(F.struct("lon", "lat"), "fixtime").alias("p"))
    dusk, dawn = U.night_window(F.col("day"), F.col("p.lon"), F.col("p.lat"))
    return days.select("subject", "day", F.round(dusk / 1e6).cast("long").alias("dusk"), F.round(dawn / 1e6).cast("long").alias("dawn"))


_PIECES = SEG + """, n AS (SELECT *, epoch_us(segment_start) AS s, epoch_us(segment_end) AS e, (12 - x1 / 15) * 3600000000e0 AS shift FROM segments),
d AS (SELECT *, unnest(range(floor((s - shift) / 86400000000e0)::BIGINT, floor((e - shift - 1) / 86400000000e0)::BIGINT + 1)) AS solar_day FROM n)
SELECT event_id, solar_day, round((least(e, solar_day * 86400000000e0 + shift + 86400000000e0) - greatest(s, solar_day * 86400000000e0 + shift)) / nullif(e - s, 0), 6) AS piece_share FROM d"""
query("t10_solar_days", _PIECES)(lambda s, d: U.solar_day_pieces(segments(s, d)).select(F.col("extra__event_id").alias("event_id"), "solar_day", F.round("piece_share", 6).alias("piece_share")))

def _split(where: str) -> str:
    """Segments split at solar noons: p0, p1 and their share."""
    return SEG + f""", n AS (SELECT *, epoch_us(segment_start) AS s, epoch_us(segment_end) AS e, (12 - x1 / 15) * 3600000000e0 AS shift FROM segments WHERE {where}),
d AS (SELECT *, unnest(range(floor((s - shift) / 86400000000e0)::BIGINT, greatest(floor((s - shift) / 86400000000e0), floor((e - shift - 1) / 86400000000e0))::BIGINT + 1)) AS day FROM n),
p AS (SELECT groupby_col, day, x1, y1, dist_meters, e - s AS span, greatest(s, day * 86400000000e0 + shift) AS p0, least(e, day * 86400000000e0 + shift + 86400000000e0) AS p1 FROM d),
t AS (SELECT *, coalesce((p1 - p0) / nullif(span, 0), 1) AS share FROM p)"""


_NIGHT = "CASE WHEN dusk IS NOT NULL AND dawn IS NOT NULL THEN greatest(least(p1, dawn) - greatest(p0, dusk), 0) / nullif(p1 - p0, 0) END AS night"
query("t11_day_night_distance", _split("true") + f""", k AS (SELECT *, x1 AS lon, y1 AS lat FROM t), r AS (SELECT *, {_NIGHT} FROM {_nights("k", 0)})
SELECT groupby_col, day AS solar_day, round(sum(dist_meters * share * (1 - coalesce(night, 0))), 2) + 0 AS day_dist, round(sum(dist_meters * share * coalesce(night, 0)), 2) + 0 AS night_dist FROM r GROUP BY 1, 2""")(lambda s, d: U.day_night_distance(segments(s, d)).select("groupby_col", "solar_day", F.round("day_dist", 2).alias("day_dist"), F.round("night_dist", 2).alias("night_dist")))
query("a5_night_day_ratio", _split("timespan_seconds <= 86400") + f""", w AS (SELECT groupby_col, day, arg_min(x1, p0) AS lon, arg_min(y1, p0) AS lat FROM t GROUP BY 1, 2), k AS (SELECT * FROM {_nights("w", -6)}),
r AS (SELECT groupby_col, day, (p1 - p0) / 3600000000e0 AS hours, dist_meters * share / 1000 AS km, {_NIGHT} FROM t JOIN k USING (groupby_col, day)),
v AS (SELECT groupby_col, sum(hours * night) AS nh, sum(hours * (1 - night)) AS dh, sum(km * night) AS nk, sum(km * (1 - night)) AS dk FROM r WHERE night IS NOT NULL GROUP BY groupby_col, day),
g AS (SELECT groupby_col, nh + dh AS hours, (nk / nh) / nullif(nk / nh + dk / dh, 0) AS share FROM v WHERE nh > 1 AND dh > 1),
o AS (SELECT groupby_col, sum(share * hours) / sum(hours) AS s, count(*) AS n_days FROM g WHERE share IS NOT NULL GROUP BY 1) SELECT groupby_col, round(CASE WHEN s >= 1 THEN 'Infinity'::DOUBLE ELSE s / (1 - s) END, 4) AS ratio, n_days FROM o""")(lambda s, d: U.night_day_ratio(segments(s, d), max_gap_hours=24).select("groupby_col", F.round("ratio", 4).alias("ratio"), "n_days"))

# classes and colours


def _classed(scheme, **options):
    def run(s, d):
        df = events(s, d).select("event_id", "value")
        return C.classify(df, "value", "bound", C.breaks(df, "value", scheme, **options)).select("event_id", F.round("bound", 6).alias("bound"))

    return run


query("c1_equal_interval", "SELECT event_id, round(l + (h - l) * greatest(1, ceil(round((value - l) / (h - l) * 5, 9))) / 5, 6) AS bound FROM events, (SELECT min(value) AS l, max(value) AS h FROM events)")(_classed("equal_interval", k=5))
query("c1_quantile", "SELECT event_id, round(list_min([x for x in q if x >= value]), 6) AS bound FROM events, (SELECT quantile_cont(value, [25e-2, 5e-1, 75e-2, 1e0]) AS q FROM events)")(_classed("quantile", k=4))
query("c1_std_mean", """SELECT event_id, round(CASE WHEN value <= m - 2 * s THEN m - 2 * s WHEN value <= m - s THEN m - s WHEN value <= m + s THEN m + s WHEN value <= m + 2 * s THEN m + 2 * s ELSE h END, 6) AS bound
FROM events, (SELECT avg(value) AS m, stddev_samp(value) AS s, max(value) AS h FROM events)""")(_classed("std_mean"))
query("c1_max_breaks", """WITH v AS (SELECT DISTINCT value FROM events), g AS (SELECT value, lead(value) OVER (ORDER BY value) AS nxt FROM v), t AS (SELECT (value + nxt) / 2 AS m FROM g WHERE nxt > value ORDER BY nxt - value DESC, value DESC LIMIT 3),
b AS (SELECT list(m ORDER BY m) AS q, (SELECT max(value) FROM events) AS h FROM t) SELECT event_id, round(coalesce(list_min([x for x in q if x >= value]), h), 6) AS bound FROM events, b""")(_classed("max_breaks", k=4))
query("c2_fisher_jenks")(_classed("fisher_jenks", k=5))


@query("c1_ranges", """SELECT event_id, printf('%.1f - %.1f', l + (h - l) * (b - 1) / 4, l + (h - l) * b / 4) AS label FROM (SELECT event_id, l, h, greatest(1, ceil(round((value - l) / (h - l) * 4, 9))) AS b FROM events, (SELECT min(value) AS l, max(value) AS h FROM events))""")
def c1_ranges(s, d):
    df = events(s, d).select("event_id", "value")
    return C.classify(df, "value", "label", C.breaks(df, "value", "equal_interval", k=4), ranges=True).select("event_id", "label")


query("f16_colour_map", """WITH f AS (SELECT event_type, row_number() OVER (ORDER BY min(event_id)) - 1 AS n FROM events GROUP BY 1) SELECT event_id, CASE n % 3 WHEN 0 THEN 255 WHEN 1 THEN 10 ELSE 20 END AS red FROM events JOIN f USING (event_type)""")(
    lambda s, d: C.colour_map(events(s, d), "event_type", "rgba", [(255, 0, 0, 255), (10, 0, 0, 255), (20, 0, 0, 255)], ["event_id"]).select("event_id", F.col("rgba")[0].alias("red"))
)
query("f17_subject_colours", """WITH o AS (SELECT user_id, arg_min('#' || printf('%06X', (user_id % 140)::INT), event_id) AS own FROM events GROUP BY 1), c AS (SELECT user_id, CASE WHEN count(*) OVER (PARTITION BY own) = 1 THEN own ELSE '#FFFF00' END AS colour FROM o) SELECT user_id, colour, count(*) AS n FROM events JOIN c USING (user_id) GROUP BY 1, 2""")(
    lambda s, d: C.subject_colours(events(s, d).withColumn("rgb", F.format_string("#%06X", (F.col("user_id") % 140).cast("int"))), "user_id", "rgb", "colour", order=["event_id"]).groupBy("user_id", "colour").agg(F.count(F.lit(1)).alias("n"))
)

# seasons and images


def series(s, d):
    return S.standardise(events(s, d).select(F.col("event_type").alias("series"), F.to_date("ts").alias("img_date"), "value"), "value")


_STD = "WITH m AS (SELECT event_type AS series, ts::DATE AS img_date, avg(value) AS m FROM events GROUP BY 1, 2), n AS (SELECT series, img_date, (m - min(m) OVER w) / (max(m) OVER w - min(m) OVER w) AS ndvi FROM m WINDOW w AS (PARTITION BY series))"
query("a25_standardise", _STD + " SELECT series, strftime(img_date, '%Y-%m-%d') AS day, round(ndvi, 6) AS ndvi FROM n")(lambda s, d: series(s, d).select("series", F.date_format("img_date", "yyyy-MM-dd").alias("day"), F.round("ndvi", 6).alias("ndvi")))
@query("a25_value_cuts")
def a25_cuts(s, d):
    cuts = S.value_cuts(series(s, d), 2)
    return s.createDataFrame([tuple(cuts)] if cuts else [], "cut_0 double, cut_1 double, cut_2 double")


_WINDOWS = _STD + """, b AS (SELECT *, CASE WHEN ndvi <= 4e-1 THEN 'dry' WHEN ndvi <= 7e-1 THEN 'mid' ELSE 'wet' END AS season FROM n), r AS (SELECT *, (season IS DISTINCT FROM lag(season) OVER (PARTITION BY series ORDER BY img_date))::INT AS c FROM b),
q AS (SELECT *, sum(c) OVER (PARTITION BY series ORDER BY img_date) AS run FROM r) SELECT series, season, strftime(min(img_date), '%Y-%m-%d') AS start, strftime(max(img_date) + 1, '%Y-%m-%d') AS "end" FROM q GROUP BY series, run, season"""
query("w9_seasonal_windows", _WINDOWS)(
    lambda s, d: S.seasonal_windows(series(s, d), [0.4, 0.7], ["dry", "mid", "wet"]).select("series", "season", F.date_format("start", "yyyy-MM-dd").alias("start"), F.date_format("end", "yyyy-MM-dd").alias("end"))
)


@query("j10_classify_seasons", "SELECT event_id, CASE WHEN ts > TIMESTAMP '2024-01-03' AND ts <= TIMESTAMP '2024-01-12' THEN 'dry' WHEN ts > TIMESTAMP '2024-01-15' AND ts <= TIMESTAMP '2024-01-25' THEN 'wet' ELSE 'nan' END AS season FROM events")
def j10(s, d):
    at = lambda i, a, b: F.when(F.col("id") == 0, F.lit(a)).otherwise(F.lit(b)).cast("timestamp_ntz").alias(i)
    windows = s.range(2).select(at("start", "2024-01-03", "2024-01-15"), at("end", "2024-01-12", "2024-01-25"), F.when(F.col("id") == 0, "dry").otherwise("wet").alias("season"))
    return S.classify_seasons(events(s, d), "ts", windows).select("event_id", "season")


query("j17_history", """SELECT event_id, round(value, 4) AS value, low, high, round(mean, 6) AS mean FROM events e LEFT JOIN (SELECT dayofyear(ts) % 5 AS k, min(value) AS low, max(value) AS high, avg(value) AS mean FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1) h ON dayofyear(e.ts) % 5 = h.k
WHERE ts BETWEEN TIMESTAMP '2024-01-15' AND TIMESTAMP '2024-01-20'""")(
    lambda s, d: S.current_and_history(events(s, d), "ts", "value", F.dayofyear("ts") % 5, "2024-01-15", "2024-01-20").select("event_id", F.round("value", 4).alias("value"), "low", "high", F.round("mean", 6).alias("mean"))
)
query("j18_anomaly", """WITH b AS (SELECT user_id, avg(value) AS b FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-10' GROUP BY 1)
SELECT event_id, round(value - b, 4) + 0 AS anomaly, round(sum(value - b) OVER (PARTITION BY user_id ORDER BY ts), 4) + 0 AS cumulative FROM events JOIN b USING (user_id) WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20'""")(
    lambda s, d: S.anomaly(events(s, d), "user_id", "ts", "value", "2024-01-01", "2024-01-10", "2024-01-20").select("event_id", (F.round("anomaly", 4) + 0).alias("anomaly"), (F.round("cumulative", 4) + 0).alias("cumulative"))
)


def images(s):
    return s.range(6).select(F.concat(F.lit("img"), F.col("id")).alias("img_id"), F.expr("timestampadd(HOUR, id * 120, timestamp_ntz'2024-01-03 00:00:00')").alias("img_time"))


_IMG = "WITH i AS (SELECT k, 'img' || k AS img_id, TIMESTAMP '2024-01-03' + INTERVAL (120 * k) HOUR AS t FROM (SELECT unnest(range(6)) AS k)) "
query("j12_nearest_images", _IMG + """SELECT event_id, coalesce(string_agg(img_id, ',' ORDER BY k), '') AS images FROM (SELECT event_id, i.*, count(*) FILTER (t <= ts) OVER (PARTITION BY event_id) AS pos FROM events, i) WHERE k >= pos - 1 AND k < pos + 1 GROUP BY 1""")(
    lambda s, d: S.nearest_images(events(s, d), "event_id", "ts", images(s), 1, 1).select("event_id", F.array_join("images", ",").alias("images"))
)
query("j12_exact_images", _IMG + """, e AS (SELECT event_id, date_trunc('day', ts) AS ts FROM events) SELECT event_id, coalesce(string_agg(img_id, ',' ORDER BY k), '') AS images FROM (SELECT event_id, i.*, count(*) FILTER (t <= ts) OVER w AS pos, count(*) FILTER (t = ts) OVER w AS same FROM e, i WINDOW w AS (PARTITION BY event_id)) WHERE k >= pos - 1 - same AND k < pos + 1 GROUP BY 1""")(
    lambda s, d: S.nearest_images(events(s, d).withColumn("ts", F.date_trunc("day", "ts").cast("timestamp_ntz")), "event_id", "ts", images(s), 1, 1, exact=True).select("event_id", F.array_join("images", ",").alias("images"))
)
query("j12_nearest_image", _IMG + """SELECT event_id, arg_min(img_id, abs(epoch_us(t) - epoch_us(ts)) * 10 - k) AS images FROM events, i GROUP BY 1""")(
    lambda s, d: S.nearest_images(events(s, d), "event_id", "ts", images(s), 0, 0).select("event_id", F.array_join("images", ",").alias("images"))
)
query("j12_images_within", _IMG + """SELECT event_id, coalesce(string_agg(img_id, ',' ORDER BY k), '') AS images FROM events LEFT JOIN i ON t BETWEEN ts - INTERVAL 6 DAY AND ts + INTERVAL 3 DAY GROUP BY 1""")(
    lambda s, d: S.images_within(events(s, d), "event_id", "ts", images(s), 6, 3).select("event_id", F.array_join("images", ",").alias("images"))
)
query("j13_images_by_midpoint", _IMG + """SELECT event_id, n.img_id FROM events JOIN i ON (k = 0 OR ts > t - INTERVAL 60 HOUR) AND (k = 5 OR ts <= t + INTERVAL 60 HOUR) JOIN i n ON abs(n.k - i.k) <= 1""")(
    lambda s, d: S.images_by_midpoint(events(s, d), "ts", images(s), 1).select("event_id", "img_id")
)
# images that are a table of their own, as large as it may be: purchases among all other events

_SHOTS = """WITH u AS (SELECT event_id, ts, event_type = 'purchase' AS shot FROM events), """


def shots(s, d):
    rows = events(s, d)
    return rows.where("event_type <> 'purchase'"), rows.where("event_type = 'purchase'").select(F.col("event_id").alias("img_id"), F.col("ts").alias("img_time"))


@query("j12_asof_events", _SHOTS + """w AS (SELECT event_id, shot, last_value(CASE WHEN shot THEN event_id END IGNORE NULLS) OVER (ORDER BY ts, NOT shot, event_id ROWS UNBOUNDED PRECEDING) AS a,
 first_value(CASE WHEN shot THEN event_id END IGNORE NULLS) OVER (ORDER BY ts, NOT shot, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS b FROM u) SELECT event_id, concat_ws(',', a, b) AS images FROM w WHERE NOT shot""")
def j12_asof(s, d):
    rows, images_ = shots(s, d)
    return S.nearest_images(rows, "event_id", "ts", images_, 1, 1).select("event_id", F.array_join(F.col("images").cast("array<string>"), ",").alias("images"))


@query("j13_events_by_midpoint", _SHOTS + """w AS (SELECT *, last_value(CASE WHEN shot THEN {i: event_id, t: ts} END IGNORE NULLS) OVER (ORDER BY ts, shot, event_id ROWS UNBOUNDED PRECEDING) AS a,
 first_value(CASE WHEN shot THEN {i: event_id, t: ts} END IGNORE NULLS) OVER (ORDER BY ts, shot, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS b FROM u)
SELECT event_id, CASE WHEN a IS NULL OR b IS NOT NULL AND epoch_us(ts) > epoch_us(a.t) + (epoch_us(b.t) - epoch_us(a.t)) // 2 THEN b.i ELSE a.i END AS img_id FROM w WHERE NOT shot""")
def j13_events(s, d):
    rows, images_ = shots(s, d)
    return S.images_by_midpoint(rows, "ts", images_).select("event_id", "img_id")


query("j14_zonal_statistics", "WITH p AS (SELECT event_id % 3 AS raster_id, 34e0 + ((user_id * 7) % 50) / 1e1 + ((event_id * 37) % 101) / 1e3 AS x, -2e0 + ((user_id * 13) % 40) / 1e1 + ((event_id * 53) % 97) / 1e3 AS y, value FROM events WHERE event_type <> 'view') SELECT n_name AS spatial_index, raster_id, round(avg(value), 4) AS mean, round(sum(value), 2) AS sum, min(value) AS min, max(value) AS max FROM p JOIN nation ON x BETWEEN 34e0 + n_nationkey % 5 AND 34e0 + n_nationkey % 5 + 1 AND y BETWEEN -2e0 + 8e-1 * (n_nationkey // 5) AND -2e0 + 8e-1 * (n_nationkey // 5) + 8e-1 GROUP BY 1, 2")(
    lambda s, d: S.zonal_statistics(
        fixes(s, d).select((F.col("extra__event_id") % 3).alias("raster_id"), F.col("lon").alias("x"), F.col("lat").alias("y"), F.when(F.col("extra__event_type") == "view", -1.0).otherwise(F.col("extra__value")).alias("value")), regions(s, d), -1.0
    ).select("spatial_index", "raster_id", F.round("mean", 4).alias("mean"), F.round("sum", 2).alias("sum"), "min", "max")
)
