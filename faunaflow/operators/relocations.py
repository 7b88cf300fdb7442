"""Fixes: standard columns, soft-delete filters, centroid statistics.

Columns: groupby_col STRING, fixtime TIMESTAMP_NTZ (UTC), junk_status BOOLEAN, lon, lat DOUBLE, extra__*.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faunaflow.functions.geodesy import utm, utm_zone, with_geodesic
from faunaflow.functions.times import seconds
from faunaflow.operators.adjacent import with_adjacent

FIXED = ["groupby_col", "fixtime", "junk_status", "lon", "lat"]


def standard(df: DataFrame, groupby_col: str | None = None, time_col: str = "fixtime") -> DataFrame:
    """Standard columns; all others get the prefix extra__ unless they have it. A name that would clash raises ValueError."""
    used = {groupby_col, time_col, "lon", "lat", "junk_status"}
    rest = {c: c if c.startswith("extra__") else f"extra__{c}" for c in df.columns if c not in used}
    if len(set(rest.values())) < len(rest):
        raise ValueError("columns clash after renaming")
    key = F.col(groupby_col).cast("string") if groupby_col else F.lit("0")
    return df.select(
        key.alias("groupby_col"),
        F.col(time_col).cast("timestamp_ntz").alias("fixtime"),
        F.lit(False).alias("junk_status"),
        F.col("lon").cast("double").alias("lon"),
        F.col("lat").cast("double").alias("lat"),
        *[F.col(c).alias(n) for c, n in rest.items()],
    )


def outside_box(min_x: float = -180, max_x: float = 180, min_y: float = -90, max_y: float = 90, points: tuple = ((0.0, 0.0),)) -> Column:
    """Strictly outside the box, or exactly at a listed point."""
    out = (F.col("lon") < min_x) | (F.col("lon") > max_x) | (F.col("lat") < min_y) | (F.col("lat") > max_y)
    for x, y in points:
        out = out | ((F.col("lon") == x) & (F.col("lat") == y))
    return F.coalesce(out, F.lit(False))


def mark(df: DataFrame, condition: Column) -> DataFrame:
    return df.withColumn("junk_status", F.col("junk_status").cast("boolean") | F.coalesce(condition, F.lit(False)))


def box_filter(df: DataFrame, **box) -> DataFrame:
    return mark(df, outside_box(**box))


def date_filter(df: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Marks fixes before start or after end; both bounds are kept."""
    out = F.lit(False)
    if start:
        out = out | (F.col("fixtime") < F.lit(start).cast("timestamp_ntz"))
    if end:
        out = out | (F.col("fixtime") > F.lit(end).cast("timestamp_ntz"))
    return mark(df, out)


def reset(df: DataFrame) -> DataFrame:
    return df.withColumn("junk_status", F.lit(False))


def remove_filtered(df: DataFrame) -> DataFrame:
    return df.where(~F.coalesce(F.col("junk_status").cast("boolean"), F.lit(False)))


def clean(df: DataFrame, columns: list[str], **box) -> DataFrame:
    """Coordinate filter, junk dropped, columns chosen, their prefixes taken off."""
    rows = remove_filtered(box_filter(df, **box)).select(*columns)
    return rows.toDF(*[c.removeprefix("extra__").removeprefix("subject__") for c in columns])


def in_box(df: DataFrame, min_x: float, max_x: float, min_y: float, max_y: float, points: tuple = ((0.0, 0.0),)) -> DataFrame:
    """Drops points that are not strictly inside the box or are listed; points without a place stay."""
    inside = (F.col("lon") > min_x) & (F.col("lon") < max_x) & (F.col("lat") > min_y) & (F.col("lat") < max_y)
    for x, y in points:
        inside = inside & ~((F.col("lon") == x) & (F.col("lat") == y))
    return df.where(F.col("lon").isNull() | F.col("lat").isNull() | inside)


def _next(df: DataFrame, tie: list[str]) -> DataFrame:
    names = ["fixtime", "lon", "lat", "junk_status"]
    ahead = with_adjacent(df.where("groupby_col is not null"), "groupby_col", "fixtime", tie, after=names)
    ahead = ahead.where("after.fixtime is not null").select(*df.columns, *[F.col(f"after.{c}").alias(f"next_{c}") for c in names])
    return with_geodesic(ahead, "lon", "lat", "next_lon", "next_lat", "next_dist")


def speed_filter(df: DataFrame, max_speed_kmhr: float, tie: list[str] = ()) -> DataFrame:
    """Marks fixes from which the next one is reached too fast, neither being junk; each subject's last fix is dropped."""
    near = _next(df, list(tie))
    kmhr = F.try_divide(F.col("next_dist"), seconds("fixtime", "next_fixtime")) * 3.6
    fast = ~F.col("junk_status") & ~F.col("next_junk_status") & (kmhr > max_speed_kmhr)
    return mark(near, fast).select(*df.columns)


def distance_filter(df: DataFrame, min_dist_km: float, max_dist_km: float, tie: list[str] = ()) -> DataFrame:
    """Marks fixes too near the next one, neither being junk, or too far from it, junk or not; the last fix is dropped."""
    near = _next(df, list(tie))
    km = F.col("next_dist") / 1000
    out = (~F.col("junk_status") & ~F.col("next_junk_status") & (km < min_dist_km)) | (km > max_dist_km)
    return mark(near, out).select(*df.columns)


def projected(df: DataFrame) -> DataFrame:
    """df with x, y in the UTM zone of its group's mean place."""
    mean = df.groupBy("groupby_col").agg(utm_zone(F.avg("lon"), F.avg("lat")).alias("zone"))
    x, y = utm(F.col("lon"), F.col("lat"), F.col("zone"))
    return df.join(mean, "groupby_col").withColumns({"x": x, "y": y})


def centroid_distances(df: DataFrame) -> DataFrame:
    """df with centroid_dist: metres from the centroid of the group's distinct points."""
    rows = projected(df)
    centre = rows.select("groupby_col", "x", "y").distinct().groupBy("groupby_col").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    dist = F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy"))
    return rows.join(centre, "groupby_col").select(*df.columns, dist.alias("centroid_dist"))


def cluster_stats(df: DataFrame, threshold: float) -> DataFrame:
    """groupby_col, cluster_radius, cluster_std_dev (population), points_within of the threshold."""
    rows = centroid_distances(df)
    return rows.groupBy("groupby_col").agg(
        F.max("centroid_dist").alias("cluster_radius"),
        F.stddev_pop("centroid_dist").alias("cluster_std_dev"),
        F.count_if(F.col("centroid_dist") <= threshold).alias("points_within"),
    )


def threshold_filter(df: DataFrame, threshold: float) -> DataFrame:
    return mark(centroid_distances(df), F.col("centroid_dist") > threshold).select(*df.columns)


def immobility(df: DataFrame, radius: float = 13, time: float = 18000, probability: float = 0.8) -> DataFrame:
    """groupby_col, status, n, share, timespan: immobile where enough fixes lie within the radius over a long enough span."""
    rows = centroid_distances(remove_filtered(df))
    stats = rows.groupBy("groupby_col").agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("centroid_dist") <= radius).cast("double")).alias("share"), seconds("min(fixtime)", "max(fixtime)").alias("timespan")
    )
    status = F.when(F.col("timespan") < time, "insufficient").when((F.col("share") >= probability) & (F.col("timespan") > time), "immobile").otherwise("mobile")
    return stats.withColumn("status", status)
