"""Fixes, regions and patrols derived from the given tables, in Spark and, for the oracle, in SQL.

The integer arithmetic gives the same doubles in both engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faunaflow.functions.geodesy import A, B, FLAT

LON = "34e0 + ((user_id * 7) % 50) / 1e1 + ((event_id * 37) % 101) / 1e3"
LAT = "-2e0 + ((user_id * 13) % 40) / 1e1 + ((event_id * 53) % 97) / 1e3"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).selectExpr("cast(user_id as string) as subject", "ts as fixtime", f"{LON} as lon", f"{LAT} as lat", "event_id as extra__event_id", "event_type as extra__event_type", "value as extra__value")


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rectangle for each nation, as a ring."""
    cells = table(spark, sf_dir, "nation").selectExpr(
        "n_nationkey as pk", "n_name as name", "34e0 + (n_nationkey % 5) as x0", "-2e0 + 8e-1 * (n_nationkey div 5) as y0"
    )
    return cells.selectExpr(
        "pk",
        "name",
        "array(named_struct('x', x0, 'y', y0), named_struct('x', x0 + 1, 'y', y0), named_struct('x', x0 + 1, 'y', y0 + 8e-1), named_struct('x', x0, 'y', y0 + 8e-1)) as ring",
    )


SQL_FIXES = f"fixes AS (SELECT event_id, CAST(user_id AS VARCHAR) AS groupby_col, ts AS fixtime, {LON} AS lon, {LAT} AS lat, event_type, value FROM events)"
SQL_REGIONS = "regions AS (SELECT n_nationkey AS pk, n_name AS name, 34e0 + (n_nationkey % 5) AS x0, 34e0 + (n_nationkey % 5) + 1 AS x1, -2e0 + 8e-1 * (n_nationkey // 5) AS y0, -2e0 + 8e-1 * (n_nationkey // 5) + 8e-1 AS y1 FROM nation)"


#: Fixed-point steps of the oracle's geodesic; enough for short segments.
STEPS = 8


def _num(x: float) -> str:
    """A double, not a decimal, in SQL."""
    return repr(x) if "e" in repr(x) else f"{x!r}e0"


def steps(lon1: str, lat1: str, lon2: str, lat2: str) -> list[dict[str, str]]:
    """The calculation as named SQL expressions, one dict for each projection; the last gives g_dist and g_azimuth."""
    out = [{"g_l": f"radians({lon2} - {lon1})", "g_u1": f"atan({_num(1 - FLAT)} * tan(radians({lat1})))", "g_u2": f"atan({_num(1 - FLAT)} * tan(radians({lat2})))"}]
    out.append({"g_s1": "sin(g_u1)", "g_c1": "cos(g_u1)", "g_s2": "sin(g_u2)", "g_c2": "cos(g_u2)", "g_lam": "g_l"})
    for k in range(STEPS):
        out.append({"g_east": "g_c2 * sin(g_lam)", "g_north": "g_c1 * g_s2 - g_s1 * g_c2 * cos(g_lam)", "g_cs": "g_s1 * g_s2 + g_c1 * g_c2 * cos(g_lam)"})
        out.append({"g_ss": "sqrt(g_east * g_east + g_north * g_north)"})
        out.append({"g_sig": "atan2(g_ss, g_cs)", "g_sa": "CASE WHEN g_ss = 0 THEN 0e0 ELSE g_c1 * g_c2 * sin(g_lam) / g_ss END"})
        out.append({"g_ca2": "1 - g_sa * g_sa"})
        out.append({"g_m": "CASE WHEN g_ca2 < 1e-15 THEN 0e0 ELSE g_cs - 2 * g_s1 * g_s2 / g_ca2 END", "g_cc": f"{_num(FLAT / 16)} * g_ca2 * (4 + {_num(FLAT)} * (4 - 3 * g_ca2))"})
        if k < STEPS - 1:
            out.append({"g_lam": f"g_l + (1 - g_cc) * {_num(FLAT)} * g_sa * (g_sig + g_cc * g_ss * (g_m + g_cc * g_cs * (2 * g_m * g_m - 1)))"})
    out.append({"g_k": f"g_ca2 * {_num((A * A - B * B) / (B * B))}"})
    out.append({"g_a": "1 + g_k / 16384 * (4096 + g_k * (g_k * (320 - 175 * g_k) - 768))", "g_b": "g_k / 1024 * (256 + g_k * (g_k * (74 - 47 * g_k) - 128))"})
    turn = "g_b * g_ss * (g_m + g_b / 4 * (g_cs * (2 * g_m * g_m - 1) - g_b / 6 * g_m * (4 * g_ss * g_ss - 3) * (4 * g_m * g_m - 3)))"
    out.append({"g_dist": f"{_num(B)} * g_a * (g_sig - {turn})", "g_azimuth": "CASE WHEN g_ss = 0 THEN 0e0 ELSE degrees(atan2(g_east, g_north)) END"})
    out.append({"g_azimuth": "CASE WHEN g_azimuth < 0 THEN g_azimuth + 360 ELSE g_azimuth END"})
    return out


def sql_geodesic(source: str, lon1: str, lat1: str, lon2: str, lat2: str, dist: str, azimuth: str) -> str:
    """A subquery that adds the two columns to source."""
    have: set[str] = set()
    for step in steps(lon1, lat1, lon2, lat2):
        old = ", ".join(f"{e} AS {n}" for n, e in step.items() if n in have)
        new = "".join(f", {e} AS {n}" for n, e in step.items() if n not in have)
        source = f"(SELECT *{f' REPLACE ({old})' if old else ''}{new} FROM {source})"
        have |= step.keys()
    return f"(SELECT * EXCLUDE ({', '.join(sorted(have))}), g_dist AS {dist}, g_azimuth AS {azimuth} FROM {source})"


_PAIRED = """(SELECT event_id, event_type, value, groupby_col, fixtime AS segment_start, lead(fixtime) OVER w AS segment_end,
  lon AS x1, lat AS y1, lead(lon) OVER w AS x2, lead(lat) OVER w AS y2, first_value(lon) OVER w AS x0, first_value(lat) OVER w AS y0
  FROM fixes WINDOW w AS (PARTITION BY groupby_col ORDER BY fixtime))"""
SQL_SEGMENTS = (
    f"{SQL_FIXES}, paired AS (SELECT *, (epoch_us(segment_end) - epoch_us(segment_start)) / 1e6 AS timespan_seconds FROM {_PAIRED} WHERE segment_end IS NOT NULL), "
    f"segments AS (SELECT *, dist_meters / nullif(timespan_seconds, 0) * 36e-1 AS speed_kmhr, (from_first / 1000) ** 2 AS nsd FROM "
    f"{sql_geodesic(sql_geodesic('paired', 'x1', 'y1', 'x2', 'y2', 'dist_meters', 'heading'), 'x0', 'y0', 'x2', 'y2', 'from_first', 'az0')})"
)


_UTM = [
    {"u_t": "sinh(atanh(sin(radians({lat}))) - u_e * atanh(u_e * sin(radians({lat}))))", "u_lam": "radians({lon} - (({zone} % 100) * 6 - 183))"},
    {"u_xi": "atan2(u_t, cos(u_lam))", "u_eta": "atanh(sin(u_lam) / sqrt(1 + u_t * u_t))"},
]
_N = FLAT / (2 - FLAT)
_TERMS = {
    1: _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180, 2: 13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    3: 61 * _N**3 / 240 - 103 * _N**4 / 140, 4: 49561 * _N**4 / 161280,
}


def sql_zone(lon: str, lat: str) -> str:
    return f"(CASE WHEN {lat} >= 0 THEN 32600 ELSE 32700 END + least(floor(({lon} + 180) / 6) + 1, 60))::INT"


def sql_utm(source: str, lon: str, lat: str, zone: str) -> str:
    """A subquery that adds x and y, metres in the UTM zone of each row, to source."""
    source = f"(SELECT *, {_num(2 * _N**0.5 / (1 + _N))} AS u_e FROM {source})"
    for step in _UTM:
        source = f"(SELECT *, {', '.join(f'{e.format(lon=lon, lat=lat, zone=zone)} AS {k}' for k, e in step.items())} FROM {source})"
    scale = _num(0.9996 * A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64))
    east = " + ".join(["u_eta", *[f"{_num(a)} * cos({2 * j} * u_xi) * sinh({2 * j} * u_eta)" for j, a in _TERMS.items()]])
    north = " + ".join(["u_xi", *[f"{_num(a)} * sin({2 * j} * u_xi) * cosh({2 * j} * u_eta)" for j, a in _TERMS.items()]])
    return f"(SELECT * EXCLUDE (u_e, u_t, u_lam, u_xi, u_eta), 500000 + {scale} * ({east}) AS x, CASE WHEN {zone} >= 32700 THEN 1e7 ELSE 0e0 END + {scale} * ({north}) AS y FROM {source})"
