"""Field-event tables: clean-up, keys in time, summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from faunaflow.functions.times import micros
from faunaflow.jobs.tables import SQL_FIXES, SQL_SEGMENTS, events, fixes, table
from faunaflow.jobs.tracking import segments
from faunaflow.operators import columns as C
from faunaflow.operators import summary as S
from faunaflow.operators import timekeys as K
from faunaflow.operators.summary import Metric

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


ev = events

query("p8_compare", "SELECT event_id FROM events WHERE event_type IS DISTINCT FROM 'click' AND value >= 20")(
    lambda s, d: C.compare(C.compare(ev(s, d), "event_type", "ne", "click"), "value", "ge", 20).select("event_id")
)
query("p9_drop_missing", "SELECT event_id, v FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS v FROM events) WHERE v IS NOT NULL")(
    lambda s, d: C.drop_missing(ev(s, d).select("event_id", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("v")), "v")
)
query("p15_map_columns", "SELECT user_id AS subject, event_id, value FROM events")(
    lambda s, d: C.reorder(C.map_columns(ev(s, d), drop=["props"], retain=["event_id", "user_id", "value"], rename={"user_id": "subject"}), ["subject"])
)
query("p16_headers", 'SELECT event_id AS "Id", value AS "Value", user_id FROM events')(
    lambda s, d: C.title_case(C.strip_prefix(ev(s, d).select(F.col("event_id").alias("x__event_id"), F.col("value").alias("x__event_value"), "user_id"), "x__"), "event_")
)
query("p17_map_values", "SELECT event_id, CASE event_type WHEN 'click' THEN 'C' WHEN 'view' THEN 'V' ELSE 'other' END AS event_type FROM events")(
    lambda s, d: C.map_values(ev(s, d), "event_type", {"click": "C", "view": "V"}, "replace", "other").select("event_id", "event_type")
)
query("p18_assign_and_fill", "SELECT event_id, 'x' AS tag, coalesce(CASE WHEN value > 20 THEN value END, 0) AS value FROM events")(
    lambda s, d: C.assign(ev(s, d), "tag", "x").withColumn("value", F.when(F.col("value") > 20, F.col("value"))).na.fill(0, ["value"]).select("event_id", "tag", "value")
)
query("p21_sql", "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events WHERE value > 10 GROUP BY event_type HAVING count(*) > 5 ORDER BY n DESC LIMIT 3")(
    lambda s, d: C.run_sql(ev(s, d), "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM df WHERE value > 10 GROUP BY event_type HAVING count(*) > 5 ORDER BY n DESC LIMIT 3")
)
query("o1_sort_limit", "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 25 OFFSET 5")(
    lambda s, d: ev(s, d).select("event_id", "value").orderBy(F.desc("value"), "event_id").offset(5).limit(25)
)
query("o2_fix_order", f"WITH {SQL_FIXES} SELECT groupby_col, epoch_us(fixtime) AS t, event_id FROM fixes")(
    lambda s, d: fixes(s, d).select(F.col("subject").alias("groupby_col"), micros("fixtime").alias("t"), F.col("extra__event_id").alias("event_id")).orderBy("groupby_col", "t", "event_id")
)
query("u1_concat", "SELECT event_id, event_type, NULL::DOUBLE AS value, NULL::VARCHAR AS note FROM events UNION ALL SELECT event_id, NULL, value, NULL FROM events WHERE value > 50")(
    lambda s, d: C.concat([ev(s, d).select("event_id", "event_type"), ev(s, d).where("value > 50").select("event_id", "value")], ["note"])
)
query("u2_group_keys", "SELECT coalesce(CASE WHEN event_type <> 'view' THEN event_type END, 'None') AS k, 'True' AS \"All\", count(*) AS n FROM events GROUP BY 1")(
    lambda s, d: ev(s, d).select(F.coalesce(F.when(F.col("event_type") != "view", F.col("event_type")), F.lit("None")).alias("k"), F.lit("True").alias("All")).groupBy("k", "All").agg(F.count(F.lit(1)).alias("n"))
)
query("u3_first_by_key", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n = 1")(
    lambda s, d: C.first_by_key(ev(s, d), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id")
)

# summaries

query("a1_summary", """SELECT event_type, round(sum(value) / 1000, 6) AS total_km, count(value) AS n, min(value) AS least, max(value) AS most, round(avg(value), 2) AS mean,
  count(DISTINCT user_id) AS users, median(value) AS mid FROM events GROUP BY 1""")(
    lambda s, d: S.summarize(ev(s, d), [
        Metric("total_km", "sum", "value", units=("m", "km"), decimals=6), Metric("n", "count", "value"), Metric("least", "min", "value"), Metric("most", "max", "value"),
        Metric("mean", "mean", "value", decimals=2), Metric("users", "nunique", "user_id"), Metric("mid", "median", "value")], ["event_type"])
)
query("a2_unique", "SELECT user_id, string_agg(event_type, ', ' ORDER BY f) AS kinds FROM (SELECT user_id, event_type, min(event_id) AS f FROM events GROUP BY 1, 2) GROUP BY 1")(
    lambda s, d: S.summarize(ev(s, d), [Metric("kinds", "unique", "event_type", order="event_id")], ["user_id"])
)
query("a3_ratio", "SELECT event_type, round(sum(value) / sum(user_id) * 100, 6) AS r FROM events GROUP BY 1")(
    lambda s, d: S.summarize(ev(s, d), [Metric("r", "ratio", "value", by="user_id", scale=100, decimals=6)], ["event_type"])
)
_PATROLS = f"""WITH {SQL_SEGMENTS}, p AS (SELECT *, groupby_col || '_' || strftime(segment_start, '%Y-%m-%d') AS patrol_id, strftime(segment_start, '%Y-%m-%d') AS segment_start_date FROM segments)"""


def patrol_segments(s, d):
    day = F.date_format("segment_start", "yyyy-MM-dd")
    return segments(s, d).withColumns({"patrol_id": F.concat_ws("_", "groupby_col", day), "segment_start_date": day})


query("a4_a6_patrol_effort", _PATROLS + """SELECT groupby_col, count(DISTINCT patrol_id) AS no_of_patrols, count(DISTINCT segment_start_date) AS patrol_days, round(sum(dist_meters) / 1000, 2) AS distance_km,
  round(sum(timespan_seconds) / 3600, 2) AS duration_h, round(sum(dist_meters * 500 + 32 * sin(2 * pi() / 64) * 250 ** 2) / 1e6, 2) AS area_km2 FROM p GROUP BY 1""")(
    lambda s, d: S.summarize(patrol_segments(s, d), S.patrol_metrics(), ["groupby_col"])
)


@query("a7_encounter_rates", _PATROLS + """, e AS (SELECT CAST(user_id AS VARCHAR) AS groupby_col, event_type FROM events WHERE event_type IN ('click', 'view')),
u AS (SELECT groupby_col, patrol_id, segment_start_date, dist_meters, timespan_seconds, NULL AS event_type FROM p UNION ALL SELECT groupby_col, NULL, NULL, NULL, NULL, event_type FROM e)
SELECT groupby_col, count(event_type) AS encounters, round(sum(timespan_seconds) / 3600, 2) AS hours, round(count(event_type) / (sum(dist_meters) / 1000), 6) AS per_km,
  count(event_type) / count(DISTINCT patrol_id) AS per_patrol, count(event_type) / count(DISTINCT patrol_id || segment_start_date) AS per_patrol_day FROM u GROUP BY 1""")
def a7(s, d):
    seg = patrol_segments(s, d).select("groupby_col", "patrol_id", "segment_start_date", "dist_meters", "timespan_seconds")
    seen = ev(s, d).where("event_type in ('click', 'view')").select(F.col("user_id").cast("string").alias("groupby_col"), "event_type")
    got = S.encounter_rates(seg, seen, ["groupby_col"])
    return got.select("groupby_col", "encounters", F.round("hours", 2).alias("hours"), F.round("per_km", 6).alias("per_km"), "per_patrol", "per_patrol_day")


query("a8_scalars", "SELECT count(*) AS n, round(avg(value), 6) AS mean, round(sum(value), 2) AS total, max(value) AS most, min(value) AS least, count(DISTINCT event_type) AS kinds, arg_min(event_type, event_id) AS first_kind FROM events")(
    lambda s, d: ev(s, d).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.sum("value"), 2).alias("total"), F.max("value").alias("most"), F.min("value").alias("least"), F.countDistinct("event_type").alias("kinds"), F.min_by("event_type", "event_id").alias("first_kind"))
)
query("a9_percentile", "SELECT event_type, round(quantile_cont(value, 0.9), 6) AS p90 FROM events GROUP BY 1")(
    lambda s, d: ev(s, d).groupBy("event_type").agg(F.round(F.percentile("value", F.lit(0.9)), 6).alias("p90"))
)


@query("a10_over_rows", """SELECT event_id, round(v + u + coalesce(w, 0), 6) AS total, 2 + (w IS NOT NULL)::INT::BIGINT AS n, least(v, u, w) AS low, greatest(v, u, w) AS high,
  round((v + u + coalesce(w, 0)) / (2 + (w IS NOT NULL)::INT), 6) AS mean, list_aggregate([v, u, w], 'median') AS mid FROM (SELECT event_id, value AS v, user_id::DOUBLE AS u, CASE WHEN event_id % 2 = 0 THEN (event_id % 7)::DOUBLE END AS w FROM events)""")
def a10(s, d):
    df = ev(s, d).selectExpr("event_id", "value as v", "double(user_id) as u", "case when event_id % 2 = 0 then double(event_id % 7) end as w")
    for op, out in {"sum": "total", "count": "n", "min": "low", "max": "high", "mean": "mean", "median": "mid"}.items():
        df = C.over_rows(df, ["v", "u", "w"], op, out)
    return df.select("event_id", F.round("total", 6).alias("total"), "n", "low", "high", F.round("mean", 6).alias("mean"), "mid")


query("a11_time_buckets", "SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS bucket, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")(
    lambda s, d: S.time_buckets(ev(s, d), "ts", "week", ["event_type"], [Metric("n", "count"), Metric("total", "sum", "value", decimals=2)]).withColumn("bucket", F.date_format("bucket", "yyyy-MM-dd"))
)
query("a11_week_of_month", "SELECT strftime(ts, '%Y-%m') AS month, floor(date_diff('day', date_trunc('month', ts)::DATE, ts::DATE) / 7)::BIGINT + 1 AS week, count(*) AS n FROM events GROUP BY 1, 2")(
    lambda s, d: ev(s, d).groupBy(F.date_format("ts", "yyyy-MM").alias("month"), S.week_of_month("ts").alias("week")).agg(F.count(F.lit(1)).alias("n"))
)
query("a12_complete_grid", """SELECT u.user_id, t.event_type, count(e.event_id) AS n FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT unnest(['click', 'view', 'none']) AS event_type) t
LEFT JOIN events e ON e.user_id = u.user_id AND e.event_type = t.event_type GROUP BY 1, 2""")(
    lambda s, d: S.complete_grid(ev(s, d).where("event_type in ('click', 'view') or event_type is not null"), "user_id", "event_type", ["click", "view", "none"])
)
query("a13_named_aggregates", "SELECT event_type, round(sum(value), 2) AS total, max(user_id) AS top_user, count(*) AS n FROM events GROUP BY 1")(
    lambda s, d: S.summarize(ev(s, d), [Metric("total", "sum", "value", decimals=2), Metric("top_user", "max", "user_id"), Metric("n", "count")], ["event_type"])
)
query("a22_choices", "SELECT DISTINCT strftime(ts, '%A') AS day, isodow(ts) AS place FROM events ORDER BY place")(
    lambda s, d: ev(s, d).select(F.date_format("ts", "EEEE").alias("day"), (F.weekday("ts") + 1).cast("long").alias("place")).distinct().orderBy("place")
)
query("a23_extents", f"WITH {SQL_FIXES} SELECT min(lon) AS x0, min(lat) AS y0, max(lon) AS x1, max(lat) AS y1, (min(lon) + max(lon)) / 2 AS cx FROM fixes")(
    lambda s, d: fixes(s, d).agg(F.min("lon").alias("x0"), F.min("lat").alias("y0"), F.max("lon").alias("x1"), F.max("lat").alias("y1"), ((F.min("lon") + F.max("lon")) / 2).alias("cx"))
)

# keys in time

query("t3_temporal_keys", "SELECT event_id, strftime(ts, '%Y-%m') AS \"TemporalGrouper_%Y-%m\", strftime(ts, '%B') AS \"TemporalGrouper_%B\", strftime(ts, '%j') AS \"TemporalGrouper_%j\", strftime(ts, '%A') AS \"TemporalGrouper_%A\", strftime(ts, '%H') AS \"TemporalGrouper_%H\" FROM events")(
    lambda s, d: K.add_temporal_keys(ev(s, d).select("event_id", "ts"), "ts", ["%Y-%m", "%B", "%j", "%A", "%H"]).drop("ts")
)
query("t4_components", """SELECT event_id, year(ts) AS year, month(ts) AS month, day(ts) AS day, hour(ts) AS hour, quarter(ts) AS quarter, weekofyear(ts) AS week, isodow(ts) - 1 AS weekday, dayofyear(ts) AS day_of_year,
  isodow(ts) >= 6 AS is_weekend, ts::DATE = last_day(ts::DATE) AS is_month_end, strftime(ts, '%H:%M:%S') AS time, isoyear(ts) AS iso_year FROM events""")(
    lambda s, d: K.decompose(ev(s, d), "ts", ["year", "month", "day", "hour", "quarter", "week", "weekday", "day_of_year", "is_weekend", "is_month_end", "time", "iso_year"]).drop("ts", "user_id", "event_type", "value", "props")
)
query("t1_parse_times", "SELECT event_id, epoch_us(ts) // 1000000 AS t FROM events")(
    lambda s, d: ev(s, d).select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("x")).select("event_id", F.expr("try_cast(x as timestamp_ntz)").alias("ts")).select("event_id", F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts)").alias("t"))
)
query("t2_time_zone", "SELECT event_id, strftime(ts + INTERVAL 3 HOUR, '%Y-%m-%d %H:%M:%S') AS local FROM events")(
    lambda s, d: ev(s, d).select("event_id", F.date_format(F.convert_timezone(F.lit("UTC"), F.lit("Africa/Nairobi"), "ts"), "yyyy-MM-dd HH:mm:ss").alias("local"))
)
query("t6_modis", """SELECT event_id, strftime(CASE WHEN year(a) > year(dd) THEN make_date(year(dd) + 1, 1, 1) ELSE a END, '%Y-%m-%d') AS begins FROM (SELECT event_id, dd, (dd + ((16 - (dayofyear(dd) - 1) % 16) % 16)::INT) AS a
FROM (SELECT event_id, (date_trunc('day', ts) + CASE WHEN ts = date_trunc('day', ts) THEN INTERVAL 0 DAY ELSE INTERVAL 1 DAY END)::DATE AS dd FROM events))""")(
    lambda s, d: ev(s, d).select("event_id", F.date_format(K.modis_begin("ts"), "yyyy-MM-dd").alias("begins"))
)
query("t5_j11_intervals", """WITH i AS (SELECT TIMESTAMP '2024-01-01' + INTERVAL (36 * k) HOUR AS l, TIMESTAMP '2024-01-01' + INTERVAL (36 * k + 48) HOUR AS r FROM (SELECT unnest(range(15)) AS k))
SELECT epoch_us(l) AS l, count(*) AS n, round(sum(value), 2) AS total FROM events JOIN i ON ts >= l AND ts < r GROUP BY 1""")(
    lambda s, d: K.match_intervals(ev(s, d), "ts", K.intervals(s, "2024-01-01 00:00:00", 15, 48, 12)).groupBy(micros("left").alias("l")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
)

# JSON, arithmetic, colours

query("f1_flatten_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS props__k FROM events")(lambda s, d: C.flatten_json(ev(s, d).select("event_id", "props"), "props"))
query("f2_first_field", "SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events")(lambda s, d: ev(s, d).select("event_id", C.first_field("props", ["missing", "k"], "double").alias("k")))
query("f3_as_type", "SELECT event_id, value::DOUBLE AS f, TRY_CAST(event_type AS DOUBLE) AS bad, CASE user_id WHEN 1 THEN true WHEN 0 THEN false END AS flag FROM events")(
    lambda s, d: ev(s, d).select("event_id", C.as_type("value", "float").alias("f"), C.as_type("event_type", "float").alias("bad"), C.as_type("user_id", "bool").alias("flag"))
)
query("f4_decode_details", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE json_extract_string(props, '$.k') END AS k, event_id % 5 = 0 AS bad_json FROM events")(
    lambda s, d: C.decode_details(ev(s, d).withColumn("props", F.when(F.col("event_id") % 5 == 0, "{bad").otherwise(F.col("props"))), "props").select("event_id", F.col("props")["k"].alias("k"), "bad_json")
)
query("f8_explode", "SELECT event_id, unnest(CASE WHEN event_id % 3 = 0 THEN [NULL] ELSE range(event_id % 3) END) AS x FROM events")(
    lambda s, d: C.explode_list(ev(s, d).select("event_id", F.expr("case when event_id % 3 = 0 then array() else sequence(0L, event_id % 3 - 1) end").alias("x")), "x")
)
query("f9_pack", "SELECT event_id, user_id::VARCHAR AS u, event_type AS t FROM events")(
    lambda s, d: C.pack(ev(s, d).select("event_id", "user_id", "event_type"), ["user_id", "event_type"]).select("event_id", F.col("additional")["user_id"].alias("u"), F.col("additional")["event_type"].alias("t"))
)
query("f10_convert", "SELECT event_id, coalesce(TRY_CAST(event_type AS DOUBLE), -1) AS bad, TRY_CAST(value::VARCHAR AS DOUBLE) AS good FROM events")(
    lambda s, d: ev(s, d).select("event_id", F.coalesce(F.col("event_type").try_cast("double"), F.lit(-1.0)).alias("bad"), F.col("value").cast("string").try_cast("double").alias("good"))
)


@query("f11_arithmetic", """SELECT event_id, value / nullif(user_id, 0) AS divide, floor(value / nullif(user_id, 0))::BIGINT AS floor_divide, value - user_id AS subtract, value + user_id AS add, value * user_id AS multiply,
greatest(value, user_id) AS max, least(value, user_id) AS min, CASE WHEN user_id <> 7 THEN ((event_id - 40) % (7 - user_id) + (7 - user_id)) % (7 - user_id) END AS modulo FROM events""")
def f11(s, d):
    df = ev(s, d).withColumns({"a": F.col("event_id") - 40, "b": 7 - F.col("user_id")})
    named = ["divide", "floor_divide", "subtract", "add", "multiply", "max", "min"]
    for op in named:
        df = C.arithmetic(df, "value", "user_id", op, op)
    return C.arithmetic(df, "a", "b", "modulo", "modulo").select("event_id", *named, "modulo")


query("f12_zscore", "SELECT event_id, round((value - avg(value) OVER ()) / stddev_samp(value) OVER (), 6) AS z FROM events")(lambda s, d: C.zscore(ev(s, d), "value", "z").select("event_id", F.round("z", 6).alias("z")))
query("f13_units", "SELECT event_id, round(value / 1000, 8) AS km, printf('%.1f km/h', value * 3.6) AS speed FROM events")(
    lambda s, d: ev(s, d).select("event_id", F.round(C.convert_unit(F.col("value"), "m", "km"), 8).alias("km"), C.with_unit(F.col("value"), "m/s", "km/h").alias("speed"))
)
query("f14_radius", "SELECT event_id, round(coalesce(CASE WHEN event_id % 4 <> 0 THEN value END + greatest(1 - (SELECT min(value) FROM events WHERE event_id % 4 <> 0), 0), 1), 6) AS r FROM events")(
    lambda s, d: C.shift_radius(ev(s, d).select("event_id", F.when(F.col("event_id") % 4 != 0, F.col("value")).alias("r")), "r").select("event_id", F.round("r", 6).alias("r"))
)
query("f15_colours", "SELECT n_nationkey, printf('#%02X%02X%02X', n_nationkey * 10, 7, 255) AS hex, printf('rgba(%d, 7, 255, 1.0)', n_nationkey * 10) AS css FROM nation")(
    lambda s, d: table(s, d, "nation").select("n_nationkey", C.rgb_text_to_hex(F.concat((F.col("n_nationkey") * 10).cast("string"), F.lit(",7, 255"))).alias("hex")).select("n_nationkey", "hex", C.rgba_to_css(C.hex_to_rgba(F.col("hex"))).alias("css"))
)
query("f18_value_index", "SELECT event_type AS k, 'north' AS region, count(*) AS n FROM events GROUP BY 1")(
    lambda s, d: C.assign(ev(s, d).withColumnRenamed("event_type", "k"), "region", "north").groupBy("k", "region").agg(F.count(F.lit(1)).alias("n"))
)
