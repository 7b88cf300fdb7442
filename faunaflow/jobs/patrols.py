"""Patrols, nested events, look-ups, movement graphs and trends."""

from __future__ import annotations

from pyspark.sql import functions as F

from faunaflow.functions.geodesy import mercator
from faunaflow.functions.times import micros
from faunaflow.jobs.tables import SQL_SEGMENTS, events, fixes, table
from faunaflow.jobs.tracking import segments
from faunaflow.operators import events as E
from faunaflow.operators import network as N
from faunaflow.operators import trend as T

QUERIES, SQL = {}, {}
SEG = f"WITH {SQL_SEGMENTS} "


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


query("p11_time_range", "SELECT event_id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-06 12:00:00'")(lambda s, d: E.in_range(events(s, d), "ts", "2024-01-05", "2024-01-06 12:00:00").select("event_id"))
query("p12_flags", "SELECT event_id FROM events WHERE event_id % 4 IN (1, 2)")(lambda s, d: E.flag_filter(events(s, d).withColumn("exclusion_flags", F.col("event_id") % 4), 3).select("event_id"))


def patrols(s, d):
    return events(s, d).groupBy(F.col("user_id").cast("string").alias("leader_id"), F.to_date("ts").alias("day")).agg(
        F.min("ts").alias("start_time"), F.max("ts").alias("end_time"), F.min("event_id").alias("serial_number"), F.min_by("event_type", "event_id").alias("patrol_type"), F.when(F.count(F.lit(1)) > 2, "done").otherwise("open").alias("state")
    ).withColumn("patrol_id", F.concat_ws("_", "leader_id", F.date_format("day", "yyyy-MM-dd")))


_P = "WITH p AS (SELECT CAST(user_id AS VARCHAR) AS leader_id, CAST(user_id AS VARCHAR) || '_' || strftime(ts, '%Y-%m-%d') AS patrol_id, min(ts) AS start_time, max(ts) AS end_time, min(event_id) AS serial_number, arg_min(event_type, event_id) AS patrol_type, CASE WHEN count(*) > 2 THEN 'done' ELSE 'open' END AS state FROM events GROUP BY 1, 2) "
query("p13_select_patrols", _P + "SELECT patrol_id, serial_number FROM p WHERE start_time <= TIMESTAMP '2024-01-12' AND end_time >= TIMESTAMP '2024-01-08' AND patrol_type IN ('click', 'view') AND state = 'done' ORDER BY 2")(
    lambda s, d: E.select_patrols(patrols(s, d), "2024-01-08", "2024-01-12", ["click", "view"], ["done"], known=s.createDataFrame([("click",), ("view",), ("error",)], "value string")).select("patrol_id", "serial_number")
)
query("p14_select_events", "SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'error') AND ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-09' AND event_id % 7 <> 0")(
    lambda s, d: E.select_events(
        fixes(s, d).select(F.col("extra__event_id").alias("event_id"), F.col("extra__event_type").alias("event_type"), F.col("fixtime").alias("time"), F.when(F.col("extra__event_id") % 7 != 0, F.col("lon")).alias("lon"), "lat"),
        ["click", "error"], "2024-01-03", "2024-01-09", ["event_id", "event_type", "location"],
    ).drop("location")
)
query("p19_required", "SELECT count(*) AS rows, count(*) FILTER (event_id % 9 = 0) AS null_v FROM events")(lambda s, d: E.required(events(s, d).withColumn("v", F.when(F.col("event_id") % 9 != 0, F.col("value"))), ["v"], {"event_id": "bigint", "v": "double"}))
query("p20_mixed_subtypes", "SELECT user_id, count(DISTINCT event_type) > 1 AS mixed FROM events GROUP BY 1")(lambda s, d: events(s, d).groupBy("user_id").agg((F.countDistinct("event_type") > 1).alias("mixed")))
query("j1_enrich", "SELECT event_id, c_name AS subject__c_name, n_name AS source__n_name FROM events JOIN customer ON user_id = c_custkey JOIN nation ON c_nationkey = n_nationkey")(
    lambda s, d: E.enrich(
        E.enrich(events(s, d).withColumnRenamed("user_id", "c_custkey"), table(s, d, "customer").select("c_custkey", "c_name", "c_nationkey"), "c_custkey", "subject__").withColumnRenamed("subject__c_nationkey", "n_nationkey"),
        table(s, d, "nation").select("n_nationkey", "n_name"), "n_nationkey", "source__",
    ).select("event_id", "subject__c_name", "source__n_name")
)
query("j2_patrol_tracks", _P + "SELECT event_id, patrol_id AS groupby_col FROM events JOIN p ON CAST(user_id AS VARCHAR) = leader_id AND ts >= start_time AND (p.serial_number % 50 = 0 OR ts <= end_time)")(
    lambda s, d: E.patrol_tracks(
        fixes(s, d).select(F.col("subject").alias("subject_id"), "fixtime", F.col("extra__event_id").alias("event_id")), patrols(s, d).withColumn("end_time", F.when(F.col("serial_number") % 50 != 0, F.col("end_time")))
    ).select("event_id", "groupby_col")
)


def event_types(s, d):
    kinds = events(s, d).select(F.col("event_type").alias("value")).distinct().where("value <> 'signup'")
    return kinds.select("value", F.when(F.col("value").isin("click", "view"), "Seen").otherwise(F.initcap("value")).alias("display"), F.lit(None).cast("string").alias("category_display"), F.substring("value", 1, 1).alias("category_value"))


query("j4_display_names", """SELECT event_id, CASE event_type WHEN 'click' THEN 'Seen (c)' WHEN 'view' THEN 'Seen (v)' WHEN 'signup' THEN 'signup' ELSE upper(event_type[1]) || event_type[2:] END AS event_type_display FROM events""")(
    lambda s, d: E.display_names(events(s, d), event_types(s, d), "duplicates").select("event_id", "event_type_display")
)
query("j3_patrol_types", _P + ", t AS (SELECT DISTINCT event_type, 'type ' || event_type AS name FROM events WHERE event_type <> 'error') SELECT patrol_id, name AS patrol_type__name FROM p JOIN t ON patrol_type = event_type")(
    lambda s, d: E.enrich(patrols(s, d), events(s, d).where("event_type <> 'error'").select(F.col("event_type").alias("patrol_type"), F.concat(F.lit("type "), F.col("event_type")).alias("name")).distinct(), "patrol_type", "patrol_type__").select("patrol_id", "patrol_type__name")
)


@query("j5_titled_details", "SELECT event_id, CASE WHEN event_type = 'click' THEN CASE WHEN json_extract_string(props, '$.k') = '7' THEN 'seven' ELSE json_extract_string(props, '$.k') END END AS number_of, CASE WHEN event_type <> 'click' THEN json_extract_string(props, '$.k') END AS k FROM events")
def j5(s, d):
    df = events(s, d).select("event_id", "event_type", F.from_json("props", "map<string,string>").alias("event_details"))
    fields = s.range(2).select(F.lit("click").alias("event_type"), F.lit("k").alias("key"), F.when(F.col("id") == 0, "Number of").alias("title"), F.when(F.col("id") == 1, "7").alias("code"), F.when(F.col("id") == 1, "seven").alias("label"))
    return E.titled_details(df, fields).select("event_id", F.col("event_details")["Number of"].alias("number_of"), F.col("event_details")["k"].alias("k"))


@query("j5_nested_details", """SELECT event_id, CASE event_type WHEN 'click' THEN '{"Kinds":["Click!","other",3],"Number of":' || CASE WHEN k = '7' THEN '"seven"' ELSE k END || ',"Parts":[{"Sub k":' || CASE WHEN k = '7' THEN '"SEVEN"' ELSE k END || ',"n":1},{"n":null}],"extra":{"a":[1]}}'
WHEN 'view' THEN '{"k":' || k || ',"kinds":["view","other",3],"parts":[{"k":' || k || ',"n":1},{"n":null}],"extra":{"a":[1]}}' ELSE '{"k":' || k || ',"updates":[],"kinds":["' || event_type || '","other",3],"parts":[{"k":' || k || ',"n":1},{"n":null}],"extra":{"a":[1]}}' END AS details
FROM (SELECT *, json_extract_string(props, '$.k') AS k FROM events)""")
def j5_nested(s, d):
    """Codes, lists of codes and lists of sub-forms; one type with a schema, one with an empty one, the others without."""
    k = F.get_json_object("props", "$.k")
    text = F.concat(F.lit('{"k":'), k, F.lit(',"updates":[],"kinds":["'), "event_type", F.lit('","other",3],"parts":[{"k":'), k, F.lit(',"n":1},{"n":null}],"extra":{"a":[1]}}'))
    rows = [("kinds", None, 0, "Kinds", None, None), ("k", None, 1, "Number of", None, None), ("parts", None, 2, "Parts", None, None), ("parts", "k", 0, "Sub k", None, None)]
    rows += [("k", None, 0, None, "7", "seven"), ("kinds", None, 0, None, "click", "Click!"), ("parts", "k", 0, None, "7", "SEVEN")]
    fields = s.createDataFrame([("click", *r) for r in rows] + [("view", "k", None, 0, None, None, None)], "event_type string, key string, sub_key string, place int, title string, code string, label string")
    return E.resolved_details(events(s, d).select("event_id", "event_type", text.alias("details")), fields, details="details").select("event_id", "details")


@query("f5_f6_nested_patrols", "SELECT event_id, CAST(user_id AS VARCHAR) || '_' || strftime(ts, '%Y-%m-%d') AS patrol_id, event_type, epoch_us(ts) AS t FROM events WHERE event_id % 11 <> 0")
def f5(s, d):
    flat = fixes(s, d).select(
        F.concat_ws("_", "subject", F.date_format("fixtime", "yyyy-MM-dd")).alias("patrol_id"), F.lit(1).alias("serial_number"), (F.hour("fixtime") % 2).alias("segment_id"), F.col("subject").alias("leader_id"),
        F.col("extra__event_id").alias("event_id"), F.col("extra__event_type").alias("event_type"), F.when(F.col("extra__event_id") % 11 != 0, F.col("fixtime")).alias("time"), "lon", "lat",
    )
    return E.unpack_patrol_events(E.nest_patrols(flat)).select("event_id", "patrol_id", "event_type", micros("time").alias("t"))


query("f7_attribute_map", "SELECT event_id, event_type AS a, (event_id + 1)::VARCHAR AS b FROM events")(
    lambda s, d: events(s, d).select("event_id", F.format_string('[{"attribute":"b","value":"%d"},{"attribute":"a","value":"%s"},{"attribute":"b","value":"%d"}]', F.col("event_id"), F.col("event_type"), F.col("event_id") + 1).alias("j"))
    .select("event_id", E.attribute_map("j").alias("m")).select("event_id", F.col("m")["a"].alias("a"), F.col("m")["b"].alias("b"))
)
query("j15_aligned", "SELECT user_id, coalesce(n, 0) AS n FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN (SELECT user_id, count(*) AS n FROM events WHERE value > 60 GROUP BY 1) USING (user_id)")(
    lambda s, d: E.aligned(events(s, d).where("value > 60").groupBy("user_id").agg(F.count(F.lit(1)).alias("n")), events(s, d), "user_id", {"n": 0})
)
query("j16_by_key", "SELECT user_id, a.n AS clicks, b.total FROM (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'click' AND value > 40 GROUP BY 1) a FULL JOIN (SELECT user_id, round(sum(value), 2) AS total FROM events WHERE value > 60 GROUP BY 1) b USING (user_id)")(
    lambda s, d: E.joined_by_key({
        "clicks": events(s, d).where("event_type = 'click' and value > 40").groupBy("user_id").agg(F.count(F.lit(1)).alias("n")),
        "high": events(s, d).where("value > 60").groupBy("user_id").agg(F.round(F.sum("value"), 2).alias("total")),
    }, "user_id").select("user_id", F.col("clicks.n").alias("clicks"), F.col("high.total").alias("total"))
)

# movement graphs

_E = SEG + """, s AS (SELECT *, floor(x1 / 5e-2)::BIGINT AS fx, floor(y1 / 5e-2)::BIGINT AS fy, floor(x2 / 5e-2)::BIGINT AS tx, floor(y2 / 5e-2)::BIGINT AS ty FROM segments),
e AS (SELECT DISTINCT groupby_col, least((fx, fy), (tx, ty)) AS a, greatest((fx, fy), (tx, ty)) AS b FROM s WHERE (fx, fy) <> (tx, ty)), l AS (SELECT groupby_col, a, b FROM e UNION ALL SELECT groupby_col, b, a FROM e), g AS (SELECT groupby_col, a AS node, count(*) AS degree FROM l GROUP BY 1, 2) """


def graph(s, d):
    return N.edges(segments(s, d), 0.05)


query("n1_nodes", SEG + """, v AS (SELECT groupby_col, segment_start, 0 AS k, floor(x1 / 5e-2)::BIGINT AS cx, floor(y1 / 5e-2)::BIGINT AS cy, speed_kmhr FROM segments UNION ALL SELECT groupby_col, segment_start, 1, floor(x2 / 5e-2)::BIGINT, floor(y2 / 5e-2)::BIGINT, NULL FROM segments)
SELECT groupby_col, cx, cy, count(*) FILTER (k = 0) + arg_min(k, (segment_start, k)) AS weight, round(avg(speed_kmhr), 3) AS speed FROM v GROUP BY 1, 2, 3""")(
    lambda s, d: N.nodes(segments(s, d), 0.05, ["speed_kmhr"]).select("groupby_col", "cx", "cy", "weight", F.round("speed_kmhr", 3).alias("speed"))
)
query("n2_n3_degree", _E + "SELECT groupby_col, count(*) AS nodes, sum(degree)::BIGINT AS degrees, max(degree) AS most FROM g GROUP BY 1")(
    lambda s, d: N.degree(graph(s, d)).groupBy("groupby_col").agg(F.count(F.lit(1)).alias("nodes"), F.sum("degree").alias("degrees"), F.max("degree").alias("most"))
)
query("n4_collective_influence", _E + """, r AS (SELECT groupby_col, node, node AS seen FROM g UNION SELECT groupby_col, a, b FROM l), t AS (SELECT r.groupby_col, r.node, sum(g.degree - 1) AS total FROM r JOIN g ON g.groupby_col = r.groupby_col AND g.node = r.seen GROUP BY 1, 2)
SELECT groupby_col, sum(degree * (total - degree))::BIGINT AS influence, max(degree * (total - degree))::BIGINT AS most FROM t JOIN g USING (groupby_col, node) GROUP BY 1""")(
    lambda s, d: N.collective_influence(graph(s, d)).groupBy("groupby_col").agg(F.sum("influence").alias("influence"), F.max("influence").alias("most"))
)
query("n5_betweenness", _E + """, w AS (WITH RECURSIVE r(groupby_col, s, n, d, c) AS (SELECT DISTINCT groupby_col, a, a, 0, 1e0 FROM l UNION ALL
  SELECT r.groupby_col, s, b, d + 1, sum(c) FROM r JOIN l ON l.groupby_col = r.groupby_col AND l.a = r.n WHERE d < 30 GROUP BY 1, 2, 3, 4) SELECT groupby_col, s, n, min(d) AS d, arg_min(c, d) AS c FROM r GROUP BY 1, 2, 3),
v AS (SELECT x.groupby_col, x.n, sum(x.c * y.c / z.c) / 2 AS share FROM w x JOIN w y ON y.groupby_col = x.groupby_col AND y.s = x.n AND y.d > 0 JOIN w z ON z.groupby_col = x.groupby_col AND z.s = x.s AND z.n = y.n AND z.d = x.d + y.d WHERE x.d > 0 GROUP BY 1, 2)
SELECT q.groupby_col, node[1] AS cx, node[2] AS cy, round(coalesce(share, 0), 4) AS betweenness FROM (SELECT DISTINCT groupby_col, a AS node FROM l) q LEFT JOIN v ON v.groupby_col = q.groupby_col AND v.n = q.node""")(lambda s, d: N.betweenness(graph(s, d)).withColumn("betweenness", F.round("betweenness", 4)))
query("n6_mosaic", SEG + """, n AS (SELECT groupby_col, floor(x1 / 5e-2)::BIGINT AS cx, floor(y1 / 5e-2)::BIGINT AS cy, avg(speed_kmhr) AS v FROM segments GROUP BY 1, 2, 3) SELECT cx, cy, round(avg(v), 3) AS speed_kmhr FROM n GROUP BY 1, 2""")(
    lambda s, d: N.mosaic(N.nodes(segments(s, d), 0.05, ["speed_kmhr"]), "speed_kmhr").where("speed_kmhr is not null").withColumn("speed_kmhr", F.round("speed_kmhr", 3))
)
_PATHS = SEG + """, c AS (SELECT groupby_col, speed_kmhr, floor(x1 / 5e-2)::BIGINT AS fx, floor(y1 / 5e-2)::BIGINT AS fy, floor(x2 / 5e-2)::BIGINT AS tx, floor(y2 / 5e-2)::BIGINT AS ty FROM segments),
n AS (SELECT groupby_col, fx AS cx, fy AS cy, avg(speed_kmhr) AS v FROM c GROUP BY 1, 2, 3 HAVING count(speed_kmhr) > 0),
s AS (SELECT c.*, n.v, greatest(abs(tx - fx), abs(ty - fy)) AS m, unnest(range(0, greatest(abs(tx - fx), abs(ty - fy)) + 1)) AS k FROM c JOIN n ON n.groupby_col = c.groupby_col AND n.cx = fx AND n.cy = fy),
p AS (SELECT groupby_col, v, fx + sign(tx - fx) * CASE WHEN abs(tx - fx) = m THEN k ELSE (2 * k * abs(tx - fx) + m) // (2 * m) END AS cx,
             fy + sign(ty - fy) * CASE WHEN abs(ty - fy) = m THEN k ELSE (2 * k * abs(ty - fy) + m) // (2 * m) END AS cy FROM s),
f AS (SELECT groupby_col, cx, cy, {how}(v) AS v FROM p ANTI JOIN n USING (groupby_col, cx, cy) GROUP BY 1, 2, 3 UNION ALL SELECT * FROM n)
SELECT cx, cy, round(avg(v), 3) AS speed_kmhr FROM f GROUP BY 1, 2"""
for how in N.INTERPOLATIONS:
    query(f"n6_mosaic_{how}", _PATHS.replace("{how}", {"mean": "avg"}.get(how, how)))(
        lambda s, d, how=how: N.mosaic(N.interpolated(segments(s, d), 0.05, "speed_kmhr", how), "speed_kmhr").withColumn("speed_kmhr", F.round("speed_kmhr", 3))
    )
_METRIC = ", ".join(f"radians(x{i}) * 6378137e0 AS x{i}, ln(tan(pi() / 4 + radians(y{i}) / 2)) * 6378137e0 AS y{i}" for i in (1, 2))




def _in_metres(s, d):
    at = lambda i: dict(zip((f"x{i}", f"y{i}"), mercator(F.col(f"x{i}"), F.col(f"y{i}"))))
    return segments(s, d).withColumns(at(1) | at(2))


_STEPS = SEG + f""", m AS (SELECT event_id, groupby_col, segment_start, segment_end, speed_kmhr, dist_meters, {_METRIC} FROM segments),
l AS (SELECT *, {", ".join(f"lead({c}, {k}) OVER w AS {c}_{k}" for k in (1, 2) for c in ("x1", "y1", "x2", "y2"))}, lead(segment_end, 2) OVER w AS ends FROM m WINDOW w AS (PARTITION BY groupby_col ORDER BY segment_start)),
f AS (SELECT *, sqrt((x2_2 - x1) ** 2 + (y2_2 - y1) ** 2) AS beeline, sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) + sqrt((x2_1 - x1_1) ** 2 + (y2_1 - y1_1) ** 2) + sqrt((x2_2 - x1_2) ** 2 + (y2_2 - y1_2) ** 2) AS path,
 floor(x2) = floor(x1_1) AND floor(y2) = floor(y1_1) AS a, floor(x2_1) = floor(x1_2) AND floor(y2_1) = floor(y1_2) AS b, (epoch_us(segment_start) % 86400000000) / 86400000000 * 2 * pi() AS angle FROM l WHERE ends IS NOT NULL)"""


@query("w12_step_features", _STEPS + """
SELECT event_id, round(CASE WHEN a THEN cos(atan2(y2_1 - y2, x2_1 - x2) - atan2(y2 - y1, x2 - x1)) END, 5) + 0 AS dot_product, round(CASE WHEN a AND b AND path > 0 THEN beeline / path END, 6) AS tortuosity_1,
 round(CASE WHEN beeline > 0 THEN ln((epoch_us(ends) - epoch_us(segment_start)) / 36e8 / beeline ** 2) END, 5) AS tortuosity_2, round(sin(angle), 5) + 0 AS sin_time, round(cos(angle), 5) + 0 AS cos_time, round(speed_kmhr, 3) AS speed, round(dist_meters, 2) AS step_length FROM f""")
def w12(s, d):
    rows = N.step_features(_in_metres(s, d))
    places = {"dot_product": 5, "tortuosity_1": 6, "tortuosity_2": 5, "sin_time": 5, "cos_time": 5, "speed": 3, "step_length": 2}
    return rows.select(F.col("extra__event_id").alias("event_id"), *[(F.round(c, k) + 0).alias(c) for c, k in places.items()])


@query("n1_window_nodes", _STEPS + """, g AS (SELECT *, CASE WHEN a THEN cos(atan2(y2_1 - y2, x2_1 - x2) - atan2(y2 - y1, x2 - x1)) END AS dot_product, CASE WHEN a AND b AND path > 0 THEN beeline / path END AS tortuosity_1,
  CASE WHEN beeline > 0 THEN ln((epoch_us(ends) - epoch_us(segment_start)) / 36e8 / beeline ** 2) END AS tortuosity_2 FROM f),
v AS (SELECT *, 0 AS k, floor(x1 / 5000)::BIGINT AS cx, floor(y1 / 5000)::BIGINT AS cy FROM g UNION ALL SELECT *, 1, floor(x2 / 5000)::BIGINT, floor(y2 / 5000)::BIGINT FROM g)
SELECT groupby_col, cx, cy, count(*) FILTER (k = 0) + arg_min(k, (segment_start, k)) AS weight, round(avg(dot_product) FILTER (k = 0), 4) + 0 AS dot_product, round(avg(tortuosity_1) FILTER (k = 0), 5) AS tortuosity_1, round(avg(tortuosity_2) FILTER (k = 0), 4) AS tortuosity_2,
  round(avg(sin(angle)) FILTER (k = 0), 4) + 0 AS sin_time, round(avg(cos(angle)) FILTER (k = 0), 4) + 0 AS cos_time, round(avg(speed_kmhr) FILTER (k = 0), 3) AS speed, round(avg(dist_meters) FILTER (k = 0), 2) AS step_length FROM v GROUP BY 1, 2, 3""")
def n1_windows(s, d):
    places = {"dot_product": 4, "tortuosity_1": 5, "tortuosity_2": 4, "sin_time": 4, "cos_time": 4, "speed": 3, "step_length": 2}
    return N.window_nodes(_in_metres(s, d), 5000.0).select("groupby_col", "cx", "cy", "weight", *[(F.round(c, k) + 0).alias(c) for c, k in places.items()])


# trends


def daily(s, d):
    return events(s, d).groupBy("event_type", F.dayofmonth("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("v"))


_D = "WITH d AS (SELECT event_type, day(ts) AS day, count(*) AS n, avg(value) AS v FROM events GROUP BY 1, 2) "
query("a27_linear_trend", _D + "SELECT event_type, round(regr_slope(n, day), 6) AS slope, round(regr_intercept(n, day), 6) AS intercept, round(regr_r2(n, day), 6) AS r_squared, round(regr_syy(n, day) * (1 - regr_r2(n, day)) / count(*), 4) AS mse FROM d GROUP BY 1")(
    lambda s, d: T.linear_trend(daily(s, d), "event_type", "day", "n").select("event_type", *[F.round(c, 6).alias(c) for c in ("slope", "intercept", "r_squared")], F.round("mse", 4).alias("mse"))
)
query("a27_poisson_trend")(lambda s, d: T.glm_trend(daily(s, d), "event_type", "day", "n").withColumns({c: F.round(c, 6) for c in ("intercept", "slope", "r_squared", "mse", "aic", "bic")}))
query("a27_linear_bounds", _D + """, f AS (SELECT event_type, count(*) AS n, regr_slope(n, day) AS b, regr_intercept(n, day) AS a, avg(day) AS c, regr_sxx(n, day) AS sxx, regr_syy(n, day) * (1 - regr_r2(n, day)) AS rss FROM d GROUP BY 1)
SELECT event_type, day::DOUBLE AS x, round(a + b * day, 4) AS mean, round(sqrt(rss / (f.n - 2) * (1 / f.n::DOUBLE + (day - c) ** 2 / sxx)), 5) AS error FROM d JOIN f USING (event_type)""")(
    lambda s, d: T.linear_prediction(daily(s, d), "event_type", "day", "n").select("event_type", "x", F.round("mean", 4).alias("mean"), F.round("error", 5).alias("error"))
)
query("a27_gamma_bounds")(lambda s, d: T.glm_prediction(daily(s, d), "event_type", "day", "v", "gamma").withColumns({c: F.round(c, 6) for c in ("mean", "lower", "upper")}))
for criterion in T.CRITERIA:
    query(f"a28_spline_by_{criterion}")(
        lambda s, d, criterion=criterion: T.spline_trend(daily(s, d), "event_type", "day", "v", criterion).withColumns({c: F.round(c, 6) for c in ("mean", "lower", "upper")})
    )
query("a28_penalised_spline")(lambda s, d: T.penalised_spline(daily(s, d), "event_type", "day", "v").withColumn("fitted", F.round("fitted", 6)))
query("f19_smoothing")(lambda s, d: T.smooth(daily(s, d), "event_type", "day", "v", low=0.0).withColumns({"x": F.round("x", 6), "y": F.round("y", 6)}))
