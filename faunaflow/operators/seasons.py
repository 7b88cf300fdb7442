"""Seasons, images and baselines: rows matched with tables of times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faunaflow.functions.times import MINUTE
from faunaflow.operators.adjacent import running_sum
from faunaflow.operators.asof import lines


def seasonal_windows(values: DataFrame, cuts: list[float], labels: list[str]) -> DataFrame:
    """season, start, end of runs of days (img_date, ndvi) in one class; the end is the day after the last. Series is a key column."""
    bands = zip([None, *cuts], [*cuts, None], labels)
    season = F.coalesce(*[F.when((F.lit(True) if a is None else F.col("ndvi") > a) & (F.lit(True) if b is None else F.col("ndvi") <= b), F.lit(x)) for a, b, x in bands])
    w = Window.partitionBy("series").orderBy("img_date")
    rows = values.where("ndvi is not null").withColumn("season", season)
    rows = rows.withColumn("run", F.sum((~F.col("season").eqNullSafe(F.lag("season").over(w))).cast("int")).over(w))
    return rows.groupBy("series", "run", "season").agg(F.min("img_date").alias("start"), F.date_add(F.max("img_date"), 1).alias("end")).drop("run")


def classify_seasons(df: DataFrame, time: str, windows: DataFrame, missing: str | None = "nan") -> DataFrame:
    """df with season: the window (start, end, season) with start < time <= end, else the missing label.

    Rows meet windows over days as an equi key. A row within several windows has a row for each; rows of a null time get the label.
    """
    day = lambda c: F.unix_date(F.col(c).cast("date"))
    spread = windows.where("start < end").select("start", "end", "season", F.explode(F.sequence(day("start"), day("end"))).alias("day"))
    rows = df.withColumn("day", day(time)).alias("r")
    found = rows.join(spread.alias("w"), (F.col("r.day") == F.col("w.day")) & (F.col(f"r.{time}") > F.col("w.start")) & (F.col(f"r.{time}") <= F.col("w.end")), "left")
    return found.select(*[F.col(f"r.{c}") for c in df.columns], F.coalesce("w.season", F.lit(missing)).alias("season"))


def standardise(df: DataFrame, value: str) -> DataFrame:
    """series, img_date, ndvi: the mean of each day, scaled to 0..1 over its series; nulls dropped."""
    days = df.groupBy("series", "img_date").agg(F.avg(value).alias("m")).where("m is not null")
    w = Window.partitionBy("series")
    return days.select("series", "img_date", F.try_divide(F.col("m") - F.min("m").over(w), F.max("m").over(w) - F.min("m").over(w)).alias("ndvi"))


def value_cuts(values: DataFrame, seasons: int) -> list[float]:
    """Cuts between the components of a Gaussian mixture over all values, with infinite ends; none without values."""
    import math

    import numpy as np
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.feature import VectorAssembler

    values = values.where("ndvi is not null")
    if values.isEmpty():
        return []
    rows = VectorAssembler(inputCols=["ndvi"], outputCol="v").transform(values.select("ndvi"))
    model = GaussianMixture(k=seasons, featuresCol="v", seed=42, maxIter=100).fit(rows)
    parts = sorted((float(g.mean[0]), math.sqrt(float(g.cov.toArray()[0, 0]))) for g in model.gaussians)
    low, high = values.agg(F.min("ndvi"), F.max("ndvi")).first()
    grid, cuts = np.linspace(low, high, 1000), []
    below = lambda x, p: 0.5 * (1 + math.erf((x - p[0]) / (p[1] * math.sqrt(2))))
    for left, right in zip(parts, parts[1:]):
        cuts.append(max((float(x) for x in grid if 1 - below(x, left) > below(x, right)), default=low))
    return [-math.inf, *cuts, math.inf]


def current_and_history(df: DataFrame, time: str, value: str, key: Column, since: str, until: str) -> DataFrame:
    """Rows in [since, until] with the least, largest and mean value of their key before since."""
    keyed = df.withColumn("period", key)
    history = keyed.where(F.col(time) < F.lit(since).cast("timestamp_ntz")).groupBy("period").agg(F.min(value).alias("low"), F.max(value).alias("high"), F.avg(value).alias("mean"))
    now = keyed.where(F.col(time).between(F.lit(since).cast("timestamp_ntz"), F.lit(until).cast("timestamp_ntz")))
    return now.join(history, "period", "left")


def anomaly(df: DataFrame, feature: str, time: str, value: str, history: str, start: str, end: str) -> DataFrame:
    """Values in [start, end) less their feature's mean in [history, start), and the running sum of that by feature."""
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    base = df.where((F.col(time) >= at(history)) & (F.col(time) < at(start))).groupBy(feature).agg(F.avg(value).alias("baseline"))
    rows = df.where((F.col(time) >= at(start)) & (F.col(time) < at(end))).join(base, feature).withColumn("anomaly", F.col(value) - F.col("baseline"))
    return running_sum(rows, feature, time, F.col("anomaly"), "cumulative")


def nearest_images(df: DataFrame, key: str, time: str, images: DataFrame, before: int, after: int, exact: bool = False, bucket_us: int = MINUTE) -> DataFrame:
    """key, images: ids of the images (img_id, img_time) nearest in time, ``before`` at or before and ``after`` after each row, in order.

    With exact an image of the very time of a row comes on top of them. Where both counts are 0 it is the nearest one alone, of two as
    near the later. Rows find them in the line of their place among all images (:func:`faunaflow.operators.asof.lines`); a null time has none.
    """
    if before < 0 or after < 0:
        raise ValueError("counts must not be negative")
    rows = lines(df.select(key, time), time, images, before + 1, after + 1, bucket_us)
    at = F.size(F.filter("line", lambda i: i["img_time"] <= F.col(time)))
    last, size = F.try_element_at("line", F.nullif(at, F.lit(0))), F.size("line")
    if before or after:
        same = F.coalesce(last["img_time"] == F.col(time), F.lit(False)).cast("int") if exact else F.lit(0)
        low, high = F.greatest(at - before - same, F.lit(0)), F.least(at + after, size)
    else:
        gap = lambda a, b: F.timestamp_diff("MICROSECOND", a, b)
        following = F.try_element_at("line", at + 1)["img_time"]
        earlier = following.isNull() | (gap(last["img_time"], F.col(time)) < gap(F.col(time), following))
        low = F.greatest(at - F.coalesce(earlier, F.lit(False)).cast("int"), F.lit(0))
        high = F.least(low + 1, size)
    found = F.when(size > 0, F.transform(F.slice("line", low + 1, high - low), lambda i: i["img_id"]))
    return rows.select(key, F.coalesce(found, F.array().cast(f"array<{images.schema['img_id'].dataType.simpleString()}>")).alias("images"))


def images_within(df: DataFrame, key: str, time: str, images: DataFrame, before: int, after: int) -> DataFrame:
    """key, images: ids of the images from ``before`` days before to ``after`` days after each row, both ends included, in order.

    Rows meet images over days as an equi key, each image under every day whose rows it can match. A row of a key that stands
    alone without an image has an empty list; rows of one key share theirs.
    """
    if before < 0 or after < 0:
        raise ValueError("counts must not be negative")
    day = lambda c: F.unix_date(c.cast("date"))
    spread = images.select("img_id", "img_time", F.explode(F.sequence(day(F.col("img_time")) - after, day(F.col("img_time")) + before)).alias("day"))
    rows = df.select(F.col(key).alias("key"), F.col(time).alias("time")).withColumn("day", day(F.col("time")))
    lag = F.timestamp_diff("MICROSECOND", F.col("img_time"), F.col("time"))
    met = rows.join(spread, "day", "left").withColumn("near", F.when(lag.between(-after * 86_400_000_000, before * 86_400_000_000), F.struct("img_time", "img_id")))
    found = met.groupBy("key").agg(F.array_sort(F.collect_set("near")).alias("near"))
    return found.select(F.col("key").alias(key), F.transform("near", lambda i: i["img_id"]).alias("images"))


def images_by_midpoint(df: DataFrame, time: str, images: DataFrame, radius: int = 0, bucket_us: int = MINUTE) -> DataFrame:
    """df with img_id, img_time: the image whose span between midpoints, open on the left, holds the time, and radius neighbours.

    One row for each of them. Of images of one time the first holds that time, the last what follows; a null time has no image.
    """
    rows = lines(df, time, images, radius + 1, radius + 1, bucket_us, strict=True)
    at = F.size(F.filter("line", lambda i: i["img_time"] < F.col(time)))
    last, following = F.try_element_at("line", F.nullif(at, F.lit(0)))["img_time"], F.try_element_at("line", at + 1)["img_time"]
    middle = F.timestamp_add("MICROSECOND", F.expr("timestampdiff(MICROSECOND, last, following) div 2"), F.col("last"))
    rows = rows.withColumns({"at": at, "last": last, "following": following}).where("last is not null or following is not null")
    later = F.col("following").isNotNull() & (F.col("last").isNull() | (F.col(time) > middle))
    own = F.col("at") + later.cast("int")
    first = F.greatest(own - radius, F.lit(1))
    near = rows.withColumn("image", F.explode(F.slice("line", first, F.least(own + radius, F.size("line")) - first + 1)))
    return near.select(*df.columns, "image.img_id", "image.img_time")


def zonal_statistics(pixels: DataFrame, regions: DataFrame, nodata: float) -> DataFrame:
    """spatial_index, raster_id and mean, sum, least and largest value of the pixels whose centre lies in each region."""
    from faunaflow.operators.spatial import points_in_regions

    inside = points_in_regions(pixels.where(F.col("value") != nodata), regions, "x", "y")
    return inside.groupBy("spatial_index", "raster_id").agg(F.avg("value").alias("mean"), F.sum("value").alias("sum"), F.min("value").alias("min"), F.max("value").alias("max"))
