"""Densities on grids. Cells follow from arithmetic on each row; only sums by cell are shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faunaflow.operators.spatial import grid_traversal


def point_density(df: DataFrame, x: str, y: str, size: float, value: str | None = None) -> DataFrame:
    """ix, iy, density: points strictly within each cell, or the sum of a value; cells with 0 are left out."""
    cx, cy = F.col(x) / size, F.col(y) / size
    rows = df.where((cx != F.floor(cx)) & (cy != F.floor(cy))).groupBy(F.floor(cx).alias("ix"), F.floor(cy).alias("iy"))
    amount = F.sum(F.col(value).try_cast("double")) if value else F.count(F.lit(1)).cast("double")
    return rows.agg(amount.alias("density")).where("density <> 0")


def line_density(df: DataFrame, size: float, value: str | None = None) -> DataFrame:
    """ix, iy, density: planar length of segments (x1, y1, x2, y2) in each cell, or a value spread over their length."""
    length = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    amount = F.col(value) if value else length
    rows = grid_traversal(df.withColumn("amount", F.when(length > 0, amount).otherwise(F.lit(0.0))), "x1", "y1", "x2", "y2", size)
    return rows.groupBy("ix", "iy").agg(F.sum(F.col("amount") * F.col("share")).alias("density")).where("density <> 0")


def time_density(df: DataFrame, size: float) -> DataFrame:
    """ix, iy, density: share of all time spent in each cell; the total is rounded to a tenth of a second."""
    cells = line_density(df, size, "timespan_seconds")
    total = cells.agg(F.round(F.sum("density"), 1).alias("total"))
    return cells.join(F.broadcast(total)).select("ix", "iy", F.try_divide("density", "total").alias("density"))


def with_keyed(df: DataFrame, other: DataFrame, by: list[str]) -> DataFrame:
    """df with the columns of other, which has one row for each key; null keys meet too, and rows without a partner stay."""
    names = {c: f"key_{c}" for c in by}
    other = other.withColumnsRenamed(names)
    return df.join(other, [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()], "left").drop(*names.values())


def mass_cuts(df: DataFrame, value: str, levels: list[float], by: list[str], parts: int = 512) -> DataFrame:
    """by and cut_0, cut_1, ...: for each level the value at which the running sum of a group, from the least value, is nearest to
    total * (1 - level / 100); the lesser of two as near.

    Rows shrink to distinct values and their counts. A sketch of each group gives splitters, so its values meet in ``parts`` tasks and
    not in one; sums by part, carried forward, are what stands before each. Missing values (null, NaN) count for nothing.
    """
    each = df.select(*by, F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)").groupBy(*by, "v").agg(F.count(F.lit(1)).alias("n"))
    shares = [k / parts for k in range(1, parts)]
    splits = each.groupBy(*by).agg(F.percentile_approx("v", shares, F.lit(20 * parts)).alias("splits"))
    dealt = with_keyed(each, splits, by).select(*by, "v", "n", F.size(F.filter("splits", lambda s: s < F.col("v"))).alias("part"))
    sums = dealt.groupBy(*by, "part").agg(F.sum(F.col("v") * F.col("n")).alias("mass"))
    before = Window.partitionBy(*by).orderBy("part")
    sums = sums.select(*by, "part", (F.sum("mass").over(before) - F.col("mass")).alias("base"), F.sum("mass").over(Window.partitionBy(*by)).alias("total"))
    within = Window.partitionBy(*by, "part").orderBy("v")
    runs = dealt.withColumn("through", F.sum(F.col("v") * F.col("n")).over(within))
    runs = with_keyed(runs, sums, [*by, "part"])
    runs = runs.select(*by, "v", "n", "total", (F.col("base") + F.col("through") - F.col("v") * F.col("n")).alias("start"))

    def distance(level: float) -> Column:
        """Equal values step the running sum n times by v; the best of these steps follows from the aim."""
        aim = F.col("total") * (1 - level / 100)
        step = F.coalesce(F.rint(F.try_divide(aim - F.col("start"), F.col("v"))), F.lit(1.0))
        return F.abs(F.col("start") + F.greatest(F.lit(1.0), F.least(F.col("n").cast("double"), step)) * F.col("v") - aim)

    return runs.groupBy(*by).agg(*[F.min_by("v", F.struct(distance(p), F.col("v"))).alias(f"cut_{i}") for i, p in enumerate(levels)])


def _reaches(value: str, i: int) -> Column:
    return ~F.isnan(F.col(value).cast("double")) & (F.col(value) >= F.col(f"cut_{i}"))


def percentile_levels(df: DataFrame, value: str, levels: list[float], by: list[str]) -> DataFrame:
    """df with percentile: the first level, in the order given, whose cut (:func:`mass_cuts`) the value reaches.

    It is null where no level is reached and where the value is missing; without levels df is returned unchanged.
    """
    if not levels:
        return df
    level = F.coalesce(*[F.when(_reaches(value, i), F.lit(float(p))) for i, p in enumerate(levels)])
    return with_keyed(df, mass_cuts(df, value, levels, by), by).select(*df.columns, level.alias("percentile"))


def percentile_area(df: DataFrame, value: str, levels: list[float], by: list[str], cell_area: float) -> DataFrame:
    """by, percentile, cells, area: the cells whose value reaches each level's cut; all levels in one pass."""
    reached = F.array_compact(F.array(*[F.when(_reaches(value, i), F.lit(float(p))) for i, p in enumerate(levels)]))
    rows = with_keyed(df, mass_cuts(df, value, levels, by), by).select(*by, F.explode(reached).alias("percentile"))
    return rows.groupBy(*by, "percentile").agg(F.count(F.lit(1)).alias("cells"), (F.count(F.lit(1)) * cell_area).alias("area"))


#: Levels of utilisation that are shown unless others are given.
UTILISATION = (50.0, 60.0, 70.0, 80.0, 90.0, 100.0)


def classed_utilisation(df: DataFrame, size: float, levels: tuple[float, ...] = UTILISATION) -> DataFrame:
    """percentile, density, density_bins, cells, area: the cells of each class of utilisation of segments (x1, y1, x2, y2), by time spent.

    A cell belongs to the least level whose cut (:func:`mass_cuts`) its share of the time reaches, so the classes do not overlap and
    the densest come first; cells of no class are left out. density is the class itself, density_bins its label, area in
    square units of size. Levels may repeat and come in any order; segments without length or time give no rows.
    """
    chosen = sorted({float(p) for p in levels})
    if not chosen:
        raise ValueError("no levels")
    cells = time_density(df, size).withColumn("whole", F.lit(0))
    rows = percentile_levels(cells, "density", chosen, ["whole"]).where("percentile is not null")
    found = rows.groupBy("percentile").agg(F.count(F.lit(1)).alias("cells"))
    return found.select("percentile", F.col("percentile").alias("density"), F.concat(F.col("percentile").cast("string"), F.lit(" %")).alias("density_bins"), "cells", (F.col("cells") * float(size) ** 2).alias("area"))


def line_canvas(df: DataFrame, box: tuple[float, float, float, float], width: int, height: int, value: str | None = None) -> DataFrame:
    """px, py, n: segments (x1, y1, x2, y2) that pass each pixel of a canvas over a box, or the sum of their values.

    A segment counts once for a pixel, and not where it touches a corner only (less than a billionth of its length); its parts outside
    the box, whose upper borders are outside, are left out, and segments without length take the pixel of their place.
    """
    x0, y0, x1, y1 = box
    scaled = {f"{a}{k}": (F.col(f"{a}{k}") - low) / (high - low) * n for a, low, high, n in (("x", x0, x1, width), ("y", y0, y1, height)) for k in (1, 2)}
    meets = (F.least("x1", "x2") <= width) & (F.greatest("x1", "x2") >= 0) & (F.least("y1", "y2") <= height) & (F.greatest("y1", "y2") >= 0)
    rows = df.select(*[c.alias(n) for n, c in scaled.items()], (F.col(value) if value else F.lit(1)).alias("amount")).where(meets)
    cells = grid_traversal(rows, "x1", "y1", "x2", "y2", 1.0)
    inside = F.col("ix").between(0, width - 1) & F.col("iy").between(0, height - 1)
    return cells.where(inside & (F.col("share") > 1e-9)).groupBy(F.col("ix").alias("px"), F.col("iy").alias("py")).agg(F.sum("amount").alias("n"))


def canvas(df: DataFrame, x: str, y: str, box: tuple[float, float, float, float], width: int, height: int, amount: Column | None = None) -> DataFrame:
    """px, py, n: points on a canvas of width by height over a box."""
    x0, y0, x1, y1 = box
    px = F.least(F.floor((F.col(x) - x0) / (x1 - x0) * width), F.lit(width - 1))
    py = F.least(F.floor((F.col(y) - y0) / (y1 - y0) * height), F.lit(height - 1))
    inside = F.col(x).between(x0, x1) & F.col(y).between(y0, y1)
    return df.where(inside).groupBy(px.alias("px"), py.alias("py")).agg((amount if amount is not None else F.count(F.lit(1))).alias("n"))
