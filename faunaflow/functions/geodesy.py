"""Geodesics on the WGS84 ellipsoid, in whole Arrow batches, and map projections, in column arithmetic."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

A, FLAT = 6378137.0, 1 / 298.257223563
B = A * (1 - FLAT)


@pandas_udf(T.StructType().add("dist", T.DoubleType()).add("azimuth", T.DoubleType()))
def inverse(lon1: pd.Series, lat1: pd.Series, lon2: pd.Series, lat2: pd.Series) -> pd.DataFrame:
    """Distance in metres and forward azimuth in [0, 360), by Vincenty's iteration; equal points have 0 and 0.

    Points so nearly antipodal that the iteration does not settle get the value of its last step.
    """
    lon, u1, u2 = np.radians(lon2 - lon1).to_numpy(), *(np.arctan((1 - FLAT) * np.tan(np.radians(x))).to_numpy() for x in (lat1, lat2))
    s1, c1, s2, c2, lam = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2), lon
    with np.errstate(all="ignore"):
        for _ in range(100):
            east, north = c2 * np.sin(lam), c1 * s2 - s1 * c2 * np.cos(lam)
            ss, cs = np.hypot(east, north), s1 * s2 + c1 * c2 * np.cos(lam)
            sigma, sa = np.arctan2(ss, cs), np.where(ss == 0, 0.0, c1 * c2 * np.sin(lam) / ss)
            ca2 = 1 - sa * sa
            m = np.where(ca2 < 1e-15, 0.0, cs - 2 * s1 * s2 / ca2)
            c = FLAT / 16 * ca2 * (4 + FLAT * (4 - 3 * ca2))
            before, lam = lam, lon + (1 - c) * FLAT * sa * (sigma + c * ss * (m + c * cs * (2 * m * m - 1)))
            if not (np.abs(lam - before) > 1e-13).any():
                break
        k = ca2 * (A * A - B * B) / (B * B)
        big = 1 + k / 16384 * (4096 + k * (k * (320 - 175 * k) - 768))
        small = k / 1024 * (256 + k * (k * (74 - 47 * k) - 128))
        turn = small * ss * (m + small / 4 * (cs * (2 * m * m - 1) - small / 6 * m * (4 * ss * ss - 3) * (4 * m * m - 3)))
        azimuth = np.where(ss == 0, 0.0, np.degrees(np.arctan2(east, north)) % 360)
    return pd.DataFrame({"dist": B * big * (sigma - turn), "azimuth": azimuth})


def with_geodesic(df: DataFrame, lon1: str, lat1: str, lon2: str, lat2: str, dist: str, azimuth: str | None = None) -> DataFrame:
    """df with the geodesic distance and, if named, the azimuth; null where a coordinate is null."""
    got = df.withColumn("g_inverse", inverse(lon1, lat1, lon2, lat2))
    known = " and ".join(f"{c} is not null" for c in (lon1, lat1, lon2, lat2))
    columns = {dist: F.expr(f"case when {known} then g_inverse.dist end")} | ({azimuth: F.expr(f"case when {known} then g_inverse.azimuth end")} if azimuth else {})
    return got.withColumns(columns).drop("g_inverse")


def mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """EPSG:3857 from EPSG:4326."""
    return F.radians(lon) * A, F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * A


def from_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / A), F.degrees(2 * F.atan(F.exp(y / A)) - F.lit(math.pi / 2))


def utm_zone(lon: Column, lat: Column) -> Column:
    """EPSG code of the zone: 326zz in the north, 327zz in the south."""
    return F.when(lat >= 0, 32600).otherwise(32700) + F.least(F.floor((lon + 180) / 6) + 1, F.lit(60))


def utm(lon: Column, lat: Column, zone: Column) -> tuple[Column, Column]:
    """Easting and northing in a UTM zone, by the Krueger series to the fourth order (below a millimetre)."""
    n = FLAT / (2 - FLAT)
    radius = A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
        61 * n**3 / 240 - 103 * n**4 / 140,
        49561 * n**4 / 161280,
    ]
    e = 2 * math.sqrt(n) / (1 + n)
    phi, lam = F.radians(lat), F.radians(lon - ((zone % 100) * 6 - 183))
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(alpha, 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500000 + 0.9996 * radius * east, F.when(zone >= 32700, 10000000.0).otherwise(0.0) + 0.9996 * radius * north
