"""Sun position and night, in column arithmetic (low-precision almanac formulas, good to about a hundredth of a degree)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faunaflow.functions.times import DAY, HOUR, micros

#: Microseconds at J2000.0, 2000-01-01 12:00.
J2000 = 946_728_000_000_000
RAD = math.pi / 180


def altitude(us: Column, lon: Column, lat: Column) -> Column:
    """Degrees of the sun above the horizon at a time in microseconds since 1970, UTC."""
    days = (us - J2000) / DAY
    anomaly = (357.529 + 0.98560028 * days) * RAD
    longitude = (280.459 + 0.98564736 * days + 1.915 * F.sin(anomaly) + 0.020 * F.sin(2 * anomaly)) * RAD
    tilt = (23.439 - 0.00000036 * days) * RAD
    ascension = F.atan2(F.cos(tilt) * F.sin(longitude), F.cos(longitude))
    declination = F.asin(F.sin(tilt) * F.sin(longitude))
    hour_angle = (280.46061837 + 360.98564736629 * days + lon) * RAD - ascension
    return F.degrees(F.asin(F.sin(lat * RAD) * F.sin(declination) + F.cos(lat * RAD) * F.cos(declination) * F.cos(hour_angle)))


def is_night(time: str, lon: str, lat: str) -> Column:
    return altitude(micros(time), F.col(lon), F.col(lat)) < 0


def _noon(day: Column, lon: Column) -> Column:
    """Microseconds of the mean solar noon of a day number."""
    return day * DAY + 12 * HOUR - lon / 15 * HOUR


def _declination_and_equation(us: Column) -> tuple[Column, Column]:
    """Declination in radians, and true noon less mean noon in microseconds."""
    days = (us - J2000) / DAY
    anomaly = (357.529 + 0.98560028 * days) * RAD
    mean = 280.459 + 0.98564736 * days
    longitude = (mean + 1.915 * F.sin(anomaly) + 0.020 * F.sin(2 * anomaly)) * RAD
    tilt = (23.439 - 0.00000036 * days) * RAD
    ascension = F.degrees(F.atan2(F.cos(tilt) * F.sin(longitude), F.cos(longitude)))
    late = F.pmod(ascension - mean + 180, F.lit(360.0)) - 180
    return F.asin(F.sin(tilt) * F.sin(longitude)), late / 15 * HOUR


def night_window(day: Column, lon: Column, lat: Column, horizon: float = -6.0) -> tuple[Column, Column]:
    """Dusk of a local solar day (days since 1970) and the dawn after it, in microseconds; null where the sun does not cross the horizon."""

    def edge(noon: Column, side: int) -> Column:
        guess = noon + side * 6 * HOUR
        declination, late = _declination_and_equation(guess)
        cosine = (math.sin(horizon * RAD) - F.sin(lat * RAD) * F.sin(declination)) / (F.cos(lat * RAD) * F.cos(declination))
        angle = F.when(cosine.between(-1, 1), F.degrees(F.acos(cosine)))
        return noon + late + side * angle / 15 * HOUR

    return edge(_noon(day, lon), 1), edge(_noon(day + 1, lon), -1)


def night_fraction(dusk: Column, dawn: Column, start: Column, end: Column) -> Column:
    """The share of a time span within a night; null without one."""
    return F.when(dusk.isNull() | dawn.isNull(), None).otherwise(F.try_divide(F.greatest(F.least(end, dawn) - F.greatest(start, dusk), F.lit(0.0)), end - start))


def solar_day_pieces(df: DataFrame) -> DataFrame:
    """Segments split at local solar noons: solar_day, piece_start, piece_end (microseconds), piece_share."""
    shift = (12 - F.col("x1") / 15) * HOUR
    rows = df.withColumns({"s_us": micros("segment_start"), "e_us": micros("segment_end"), "noon_shift": shift})
    first, last = F.floor((F.col("s_us") - F.col("noon_shift")) / DAY), F.floor((F.col("e_us") - F.col("noon_shift") - 1) / DAY)
    rows = rows.withColumn("solar_day", F.explode(F.sequence(first, F.greatest(first, last))))
    begin = F.col("solar_day") * DAY + F.col("noon_shift")
    rows = rows.withColumns({"piece_start": F.greatest(F.col("s_us").cast("double"), begin), "piece_end": F.least(F.col("e_us").cast("double"), begin + DAY)})
    share = F.coalesce(F.try_divide(F.col("piece_end") - F.col("piece_start"), F.col("e_us") - F.col("s_us")), F.lit(1.0))
    return rows.withColumn("piece_share", share).drop("s_us", "e_us", "noon_shift")


def night_day_ratio(df: DataFrame, horizon: float = -6.0, min_phase_hours: float = 1.0, max_gap_hours: float = 6.0) -> DataFrame:
    """groupby_col, ratio, n_days: speed by night against speed by day.

    Longer segments are left out; pieces belong to the solar day from noon to noon, whose night lies at the place of its
    first piece. Days need more than an hour of either phase; their night shares of speed are weighed by observed hours.
    """
    pieces = solar_day_pieces(df.where(F.col("timespan_seconds") <= max_gap_hours * 3600))
    key = ["groupby_col", "solar_day"]
    places = pieces.groupBy(*key).agg(F.min_by(F.struct("x1", "y1"), "piece_start").alias("p"))
    dusk, dawn = night_window(F.col("solar_day"), F.col("p.x1"), F.col("p.y1"), horizon)
    placed = places.select(*key, dusk.alias("dusk"), dawn.alias("dawn"))
    rows = pieces.join(placed, key).withColumns(
        {"night": night_fraction(F.col("dusk"), F.col("dawn"), F.col("piece_start"), F.col("piece_end")), "hours": (F.col("piece_end") - F.col("piece_start")) / HOUR, "km": F.col("dist_meters") * F.col("piece_share") / 1000}
    )
    part = lambda c, w: F.sum(F.col(c) * w)
    days = rows.where("night is not null").groupBy(*key).agg(
        part("hours", F.col("night")).alias("nh"), part("hours", 1 - F.col("night")).alias("dh"), part("km", F.col("night")).alias("nk"), part("km", 1 - F.col("night")).alias("dk")
    ).where((F.col("nh") > min_phase_hours) & (F.col("dh") > min_phase_hours))
    night, day = F.col("nk") / F.col("nh"), F.col("dk") / F.col("dh")
    days = days.withColumn("share", F.try_divide(night, night + day)).where("share is not null")
    got = days.groupBy("groupby_col").agg((F.sum(F.col("share") * (F.col("nh") + F.col("dh"))) / F.sum(F.col("nh") + F.col("dh"))).alias("s"), F.count(F.lit(1)).alias("n_days"))
    ratio = F.when(F.col("s") >= 1, F.lit(float("inf"))).otherwise(F.col("s") / (1 - F.nullif(F.col("s"), F.lit(1.0))))
    return got.select("groupby_col", ratio.alias("ratio"), "n_days")


def day_night_distance(df: DataFrame, horizon: float = 0.0) -> DataFrame:
    """groupby_col, solar_day, day_dist, night_dist: metres before and after dusk or dawn."""
    pieces = solar_day_pieces(df)
    dusk, dawn = night_window(F.col("solar_day"), F.col("x1"), F.col("y1"), horizon)
    night = F.coalesce(night_fraction(dusk, dawn, F.col("piece_start"), F.col("piece_end")), F.lit(0.0))
    metres = F.col("dist_meters") * F.col("piece_share")
    return pieces.groupBy("groupby_col", "solar_day").agg(F.sum(metres * (1 - night)).alias("day_dist"), F.sum(metres * night).alias("night_dist"))
