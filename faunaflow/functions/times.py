"""Times are TIMESTAMP_NTZ in UTC, so no result depends on the session's zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY, HOUR, MINUTE = 86_400_000_000, 3_600_000_000, 60_000_000


def micros(c: str) -> Column:
    """Microseconds since 1970."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {c})")


def at_micros(c: str) -> Column:
    return F.expr(f"timestampadd(MICROSECOND, {c}, timestamp_ntz'1970-01-01 00:00:00')")


def seconds(start: str, end: str) -> Column:
    return F.expr(f"timestampdiff(MICROSECOND, {start}, {end})") / 1e6
