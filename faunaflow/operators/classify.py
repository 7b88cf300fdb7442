"""Classification of values, and colours for classes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from faunaflow.operators.columns import rgba_to_css

#: Distinct values up to which optimal breaks are exact; more start as bins, divided into PIECES wherever a break falls.
MAX_BREAK_VALUES, PIECES = 500_000, 1000
#: Parts that distinct values are dealt out over.
PARTS = 128


def breaks(df: DataFrame, column: str, scheme: str, k: int = 5, multiples: tuple = (-2, -1, 1, 2), min_gap: float = 0.0) -> list[float]:
    """Upper bounds of the classes, ascending: a few numbers from one aggregation; none where the column has no value."""
    c = F.col(column)
    known = df.where(c.isNotNull() & ~F.isnan(c.cast("double"))).select(c.cast("double").alias("v"))
    if scheme == "equal_interval":
        low, high = known.agg(F.min("v"), F.max("v")).first()
        return [] if low is None else [low + (high - low) * i / k for i in range(1, k)] + [high]
    if scheme == "quantile":
        return sorted(set(known.agg(F.percentile("v", F.array(*[F.lit(i / k) for i in range(1, k + 1)])).alias("q")).first()["q"] or []))
    if scheme == "std_mean":
        mean, dev, high = known.agg(F.avg("v"), F.stddev_samp("v"), F.max("v")).first()
        if mean is None:
            return []
        found = [mean + m * (dev or 0.0) for m in multiples]
        return found if found[-1] >= high else [*found, high]
    if scheme == "max_breaks":
        # gaps between neighbouring distinct values; the widest k - 1. Values are dealt out over parts of about
        # equal size, and only the ends of the parts are compared across them
        ends = sorted(set(known.agg(F.percentile_approx("v", [i / PARTS for i in range(1, PARTS)])).first()[0] or []))
        part = F.size(F.filter(F.array(*[F.lit(float(e)) for e in ends]), lambda e: e < F.col("v")))
        near = known.distinct().withColumn("part", part)
        within = near.withColumn("after", F.lead("v").over(Window.partitionBy("part").orderBy("v"))).select("v", "after")
        edges = near.groupBy("part").agg(F.min("v").alias("low"), F.max("v").alias("v"))
        across = edges.withColumn("after", F.lead("low").over(Window.orderBy("part"))).select("v", "after")
        gaps = within.unionByName(across).where(F.col("after") - F.col("v") > min_gap)
        top = gaps.orderBy((F.col("after") - F.col("v")).desc(), F.col("v").desc()).limit(k - 1).select(((F.col("v") + F.col("after")) / 2).alias("m"))
        most = known.agg(F.max("v")).first()[0]
        return [] if most is None else sorted([*(r["m"] for r in top.collect()), most])
    if scheme in ("fisher_jenks", "natural_breaks"):
        return _optimal(known, k)
    raise ValueError(f"unknown scheme: {scheme}")


def _best_ends(n: np.ndarray, s: np.ndarray, q: np.ndarray, k: int) -> np.ndarray:
    """Ends of the k classes of least squared deviation over ordered pieces: n rows, sums s of values, q of squares.

    The best start of a class does not fall as its end rises, so each round halves the open ranges, all of them at once.
    """
    w, s, q = (np.r_[0.0, np.cumsum(x)] for x in (n, s, q))
    spread = lambda i, j: (q[j] - q[i]) - (s[j] - s[i]) ** 2 / (w[j] - w[i])
    size, cuts = len(n), []
    best = np.r_[0.0, spread(np.zeros(size, dtype=int), np.arange(1, size + 1))]
    for c in range(2, k + 1):
        after, cut = np.full(size + 1, np.inf), np.zeros(size + 1, dtype=int)
        # open ranges of ends, and of the starts they may have
        low, high, first, last = (np.array([x]) for x in (c, size, c - 1, size - 1))
        while len(low):
            mid = (low + high) // 2
            upper = np.minimum(last, mid - 1)
            many = upper - first + 1
            at = np.r_[0, np.cumsum(many)[:-1]]
            start = np.arange(many.sum()) - np.repeat(at - first, many)
            total = best[start] + spread(start, np.repeat(mid, many))
            after[mid] = np.minimum.reduceat(total, at)
            found = np.flatnonzero(total == np.repeat(after[mid], many))
            cut[mid] = start[found[np.searchsorted(found, at)]]
            left, right = low < mid, mid < high
            pairs = (low, mid + 1), (mid - 1, high), (first, cut[mid]), (cut[mid], last)
            low, high, first, last = (np.r_[a[left], b[right]] for a, b in pairs)
        best = after
        cuts.append(cut)
    ends = [size]
    for cut in reversed(cuts):
        ends.append(cut[ends[-1]])
    return np.array(ends[::-1])


def _places(edges: np.ndarray):
    @pandas_udf("long")
    def place(v: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, v.to_numpy()))

    return place


def _optimal(known: DataFrame, k: int) -> list[float]:
    """Breaks of least squared deviation within classes.

    Up to MAX_BREAK_VALUES distinct values they are exact. More are summed in bins of about as many values each; the bins beside a
    break are divided until they are single values, so each break is the best one near it, but another set may be better on the whole.
    """
    counts = known.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    mean = known.agg(F.avg("v")).first()[0]
    if mean is None:
        return []
    d, n = F.col("v") - F.lit(mean), F.col("n")
    rows = counts.select("v", "n", (d * n).alias("s"), (d * d * n).alias("q"))
    ends = lambda got: _best_ends(*(got[c].to_numpy(float) for c in "nsq"), min(k, len(got)))
    if rows.limit(MAX_BREAK_VALUES + 1).count() <= MAX_BREAK_VALUES:
        got = rows.orderBy("v").toPandas()
        return got["v"].iloc[ends(got) - 1].tolist()
    quantiles = F.percentile_approx("v", F.array(*[F.lit(i / PIECES) for i in range(PIECES + 1)]), F.lit(100 * PIECES))
    edges = np.unique(rows.agg(quantiles).first()[0])
    while True:
        binned = rows.withColumn("b", _places(edges)("v"))
        sums = [F.min("v").alias("low"), F.max("v").alias("v"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")]
        got = binned.groupBy("b").agg(*sums).orderBy("b").toPandas()
        found = ends(got)
        beside = got.iloc[np.unique(np.r_[found[:-1] - 1, found[:-1]])]
        wide = beside[beside["low"] < beside["v"]]
        if wide.empty:
            return got["v"].iloc[found - 1].tolist()
        parts = binned.where(F.col("b").isin(wide["b"].tolist())).groupBy("b").agg(quantiles.alias("q")).collect()
        edges = np.unique(np.concatenate([edges, wide["low"], wide["v"], *[r["q"] for r in parts]]))


def classify(df: DataFrame, column: str, out: str, bounds: list[float], labels: list | None = None, ranges: bool = False, decimals: int = 1) -> DataFrame:
    """df with the label of the first bound that is not below the value: the bound, a range of bounds, or a given label; without bounds null."""
    if not bounds:
        return df.withColumn(out, F.lit(None).cast("string" if ranges else "double" if labels is None else "int" if all(isinstance(x, int) for x in labels) else "string"))
    if labels is not None and len(labels) != len(bounds):
        raise ValueError(f"{len(bounds)} classes, {len(labels)} labels")
    if ranges:
        low = df.agg(F.min(column)).first()[0]
        edge = [low, *bounds]
        labels = [f"{a:.{decimals}f} - {b:.{decimals}f}" for a, b in zip(edge, edge[1:])]
    found = F.coalesce(*[F.when(F.col(column) <= b, F.lit(x)) for b, x in zip(bounds, labels or bounds)])
    return df.withColumn(out, found)


def colour_map(df: DataFrame, column: str, out: str, colours: list[tuple] | dict, order: list[str] = ()) -> DataFrame:
    """RGBA by distinct value: a list is cycled in order of first appearance, a dict looked up; null and unknown are transparent."""
    rgba = lambda c: F.array(*[F.lit(int(x)) for x in c])
    if isinstance(colours, dict):
        table = F.create_map(*[x for k, c in colours.items() for x in (F.lit(k), rgba(c))])
        return df.withColumn(out, F.coalesce(F.element_at(table, F.col(column)), rgba((0, 0, 0, 0))))
    firsts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.min(F.struct(*order)).alias("o")).withColumn("part", F.lit(0))
    place = (F.row_number().over(Window.partitionBy("part").orderBy("o")) - 1) % len(colours)
    table = firsts.select(F.col(column).alias("c_value"), F.get(F.array(*map(rgba, colours)), place.cast("int")).alias("c_rgba"))
    return df.join(table, F.col(column) == F.col("c_value"), "left").select(*df.columns, F.coalesce("c_rgba", rgba((0, 0, 0, 0))).alias(out))


def subject_colours(df: DataFrame, id_col: str, rgb_col: str, out: str, default: str = "#FFFF00", palette: list[str] | None = None, order: list[str] = ()) -> DataFrame:
    """A colour for each subject: its own first one, unless missing or shared with others; those get the default, or the palette's by rank."""
    each = df.groupBy(id_col).agg(F.min_by(rgb_col, F.struct(*order)).alias("own"))
    shared = F.count(F.lit(1)).over(Window.partitionBy("own"))
    each = each.withColumn("own", F.when(shared == 1, F.col("own"))).withColumn("part", F.col("own").isNull())
    rank = (F.row_number().over(Window.partitionBy("part").orderBy(id_col)) - 1).cast("int")
    rest: Column = F.get(F.array(*map(F.lit, palette)), rank % len(palette)) if palette else F.lit(default)
    return df.join(each.select(id_col, F.coalesce("own", rest).alias(out)), id_col)


#: Ends and middles of some named colour ramps, evenly spaced.
RAMPS = {
    "gray": [(0, 0, 0, 255), (255, 255, 255, 255)],
    "bwr": [(0, 0, 255, 255), (255, 255, 255, 255), (255, 0, 0, 255)],
    "cool": [(0, 255, 255, 255), (255, 0, 255, 255)],
    "spring": [(255, 0, 255, 255), (255, 255, 0, 255)],
    "summer": [(0, 128, 102, 255), (255, 255, 102, 255)],
    "autumn": [(255, 0, 0, 255), (255, 255, 0, 255)],
    "winter": [(0, 0, 255, 255), (0, 255, 128, 255)],
}
#: Colours of a continuous ramp.
STEPS = 256


def ramp_colours(anchors: list[tuple], k: int) -> list[tuple]:
    """k colours spaced evenly over a ramp, for as many distinct values; from :data:`STEPS` on they begin again."""
    n = max(1, min(k, STEPS))
    at = np.linspace(0, len(anchors) - 1, n) if n > 1 else np.zeros(1)
    each = np.array([np.interp(at, range(len(anchors)), [a[c] for a in anchors]) for c in range(4)])
    steps = [tuple(int(x) for x in row) for row in np.rint(each).T]
    return [steps[i % n] for i in range(k)]


def colour_ramp(df: DataFrame, column: str, out: str, anchors: list[tuple]) -> DataFrame:
    """RGBA by number: the place of a value between the least and the greatest, in :data:`STEPS` steps over the ramp.

    Where all values are equal they take its first colour; missing values (null, NaN) are transparent. The two bounds come from one
    aggregation and are joined as one row; rows are not shuffled.
    """
    value = F.col(column).cast("double")
    known = F.when(~F.isnan(value), value)
    limits = df.agg(F.min(known).alias("ramp_low"), F.max(known).alias("ramp_high"))
    width = F.col("ramp_high") - F.col("ramp_low")
    share = (known - F.col("ramp_low")) / F.when(width == 0, 1.0).otherwise(width)
    table = F.array(*[F.array(*map(F.lit, c)) for c in ramp_colours(anchors, STEPS)])
    step = F.when(share.isNotNull(), F.least(F.floor(share * STEPS), F.lit(STEPS - 1))).cast("int")
    clear = F.array(*[F.lit(0)] * 4)
    rows = df.crossJoin(F.broadcast(limits)).withColumn(out, F.coalesce(F.get(table, step), clear))
    return rows.select(*[c for c in df.columns if c != out], out)


def legend(df: DataFrame, label: str, colour: str, sort: str | None = None, suffix: str = "", order: list[str] = ()) -> DataFrame:
    """label, colour (text for CSS): one row for each label, with the colour of its first row by ``order``.

    ``sort`` is ascending or descending: by number where every label is one, else by text; null labels come last. Without it labels
    come in the order of their first rows. The legend has a row for each label, however many rows df has.
    """
    if sort not in (None, "ascending", "descending"):
        raise ValueError(f"unknown order: {sort}")
    first = F.struct(*order) if order else F.struct(F.monotonically_increasing_id())
    each = df.select(F.col(label).alias("label"), F.col(colour).alias("rgba"), first.alias("first")).groupBy("label").agg(F.min_by("rgba", "first").alias("rgba"), F.min("first").alias("first"))
    number = F.col("label").cast("string").try_cast("double")
    each = each.crossJoin(F.broadcast(each.agg(F.every(F.col("label").isNull() | number.isNotNull()).alias("numbers"))))
    keys = [F.when(F.col("numbers"), number), F.col("label").cast("string")]
    by = {None: [F.col("first")], "ascending": [k.asc_nulls_last() for k in keys], "descending": [k.desc_nulls_last() for k in keys]}[sort]
    return each.orderBy(*by).select(F.concat(F.col("label").cast("string"), F.lit(suffix)).alias("label"), rgba_to_css(F.col("rgba")).alias("colour"))
