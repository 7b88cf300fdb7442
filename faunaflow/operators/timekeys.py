"""Grouping keys in time, and rows matched with intervals of time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed names: strftime directives as date patterns.
DIRECTIVES = {"%Y": "yyyy", "%B": "MMMM", "%Y-%m": "yyyy-MM", "%j": "DDD", "%d": "dd", "%Y-%m-%d": "yyyy-MM-dd", "%A": "EEEE", "%H": "HH"}


def add_temporal_keys(df: DataFrame, time: str, directives: list[str]) -> DataFrame:
    """A column for each directive; existing ones are kept."""
    return df.withColumns({f"TemporalGrouper_{d}": F.date_format(time, DIRECTIVES[d]) for d in directives if f"TemporalGrouper_{d}" not in df.columns})


#: Fixed names of columns that hold times.
TIME_COLUMNS = ["time", "created_at", "updated_at", "end_time", "last_position_date", "recorded_at", "fixtime", "patrol_start_time", "patrol_end_time"]


def clean_times(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """df with text in the known time columns (:data:`TIME_COLUMNS`, or those given) read as times in UTC; offsets are applied.

    Text without an offset is in UTC; null and text that is no time become null. Columns that are absent, or times already, stay.
    """

    def read(c: str) -> Column:
        text, zoned = F.trim(c), F.trim(c).rlike(r":.*(Z|[+-]\d\d?(:?\d\d)?)$")
        stamped = F.when(zoned, text).otherwise(F.concat(text, F.when(text.contains(":"), "Z").otherwise("T00:00:00Z")))
        return F.timestamp_add("MICROSECOND", F.unix_micros(stamped.try_cast("timestamp")), F.expr("timestamp_ntz'1970-01-01 00:00:00'"))

    kinds = dict(df.dtypes)
    return df.withColumns({c: read(c) for c in (TIME_COLUMNS if columns is None else columns) if kinds.get(c) == "string"})


def iso_time(time: str) -> Column:
    """A time as ISO text in UTC."""
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def to_zone(df: DataFrame, zone: str, columns: list[str] = (), auto_detect: bool = False) -> DataFrame:
    """df with instants (TIMESTAMP) in the listed columns, or in all with auto_detect, as local times of a zone (TIMESTAMP_NTZ).

    Times without a zone (TIMESTAMP_NTZ), other types and absent columns stay; both arguments at once raise ValueError.
    """
    if auto_detect and columns:
        raise ValueError("give columns or auto_detect, not both")
    kinds = dict(df.dtypes)
    chosen = df.columns if auto_detect else columns
    # from the instant itself, so that the session's zone plays no part
    utc = lambda c: F.expr(f"timestampadd(MICROSECOND, unix_micros(`{c}`), timestamp_ntz'1970-01-01 00:00:00')")
    return df.withColumns({c: F.convert_timezone(F.lit("UTC"), F.lit(zone), utc(c)) for c in chosen if kinds.get(c) == "timestamp"})


def choices(df: DataFrame, time: str, directive: str) -> DataFrame:
    """choice, place: the distinct values of a directive, in order; months and weekdays go by the calendar, weeks from Monday."""
    place = {"%B": F.month(time), "%A": F.weekday(time) + 1}.get(directive, F.lit(0))
    rows = df.where(F.col(time).isNotNull()).select(F.date_format(time, DIRECTIVES[directive]).alias("choice"), place.cast("long").alias("place"))
    return rows.distinct().orderBy("place", "choice")


def components(time: str) -> dict[str, Column]:
    c, day = F.col(time), F.to_date(time)
    weekday = F.weekday(day)
    return {
        "year": F.year(c), "month": F.month(c), "day": F.dayofmonth(c), "hour": F.hour(c), "minute": F.minute(c), "second": F.second(c), "quarter": F.quarter(c),
        "week": F.weekofyear(c), "weekday": weekday, "day_of_year": F.dayofyear(c), "month_name": F.date_format(c, "MMMM"), "day_name": F.date_format(c, "EEEE"),
        "is_weekend": weekday >= 5, "is_month_start": F.dayofmonth(c) == 1, "is_month_end": day == F.last_day(day), "is_year_start": F.dayofyear(c) == 1,
        "is_year_end": (F.month(c) == 12) & (F.dayofmonth(c) == 31), "is_quarter_start": (F.dayofmonth(c) == 1) & (F.month(c) % 3 == 1),
        "is_quarter_end": (day == F.last_day(day)) & (F.month(c) % 3 == 0), "days_in_month": F.dayofmonth(F.last_day(day)), "date": day,
        "is_leap_year": F.dayofyear(F.make_date(F.year(c), F.lit(12), F.lit(31))) == 366, "microsecond": F.date_format(c, "SSSSSS").cast("int"),
        "iso_year": F.expr(f"extract(YEAROFWEEK FROM {time})"), "time": F.date_format(c, "HH:mm:ss"),
    }


def decompose(df: DataFrame, time: str, names: list[str], prefix: str = "") -> DataFrame:
    all_ = components(time)
    return df.withColumns({prefix + n: all_[n] for n in names})


def intervals(spark: SparkSession, start: str, n: int, freq_hours: float, overlap_hours: float = 0.0) -> DataFrame:
    """left, right (TIMESTAMP_NTZ): interval i begins at start + i * (freq - overlap) and lasts freq."""
    us = lambda h: int(h * 3_600_000_000)
    left = F.expr(f"timestampadd(MICROSECOND, id * {us(freq_hours - overlap_hours)}, timestamp_ntz'{start}')")
    return spark.range(n).select(left.alias("left")).withColumn("right", F.expr(f"timestampadd(MICROSECOND, {us(freq_hours)}, left)"))


def modis_begin(time: str) -> Column:
    """The next day that begins a 16-day period counted from each 1 January, at or after the time."""
    day = F.expr(f"case when {time} = date_trunc('day', {time}) then to_date({time}) else date_add(to_date({time}), 1) end")
    ahead = F.date_add(day, ((16 - (F.dayofyear(day) - 1) % 16) % 16).cast("int"))
    return F.when(F.year(ahead) > F.year(day), F.make_date(F.year(day) + 1, F.lit(1), F.lit(1))).otherwise(ahead)


def match_intervals(df: DataFrame, time: str, table: DataFrame, closed: str = "left", how: str = "inner", bucket_days: int = 1) -> DataFrame:
    """Rows with every interval (left, right) that holds them. Days are the equi key, so either side may be large."""
    day = lambda c: F.floor(F.unix_date(F.to_date(c)) / bucket_days)
    spans = table.withColumn("i_day", F.explode(F.sequence(day("left"), day("right"))))
    t = F.col(time)
    after = t >= F.col("left") if closed in ("left", "both") else t > F.col("left")
    before = t <= F.col("right") if closed in ("right", "both") else t < F.col("right")
    return df.join(spans, (day(time) == F.col("i_day")) & after & before, how).drop("i_day")
