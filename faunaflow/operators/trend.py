"""Trends and smoothing of series: one series is a group; many run in parallel."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faunaflow.functions.stages import written


def linear_trend(df: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """key, slope, intercept, r_squared, mse, aic, bic of least squares, in one aggregation."""
    n, k = F.count(F.lit(1)), 2
    got = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(key).agg(
        n.alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r_squared"), F.regr_syy(y, x).alias("syy")
    )
    rss = F.col("syy") * (1 - F.col("r_squared"))
    fit = F.col("n") * F.log(F.try_divide(rss, "n"))
    return got.select(key, "n", "slope", "intercept", "r_squared", F.try_divide(rss, F.col("n")).alias("mse"), (fit + 2 * k).alias("aic"), (fit + F.log("n") * k).alias("bic"))


def t_quantile(share: float, freedom: float) -> float:
    """Student's t: exact for up to 200 degrees of freedom, beyond by its expansion about the normal quantile."""
    z, v = NormalDist().inv_cdf(share), float(freedom)
    if v > 200 or v != int(v):
        return z + (z**3 + z) / (4 * v) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * v**2) + (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / (384 * v**3)
    n = int(v)

    def within(t: float) -> float:
        """The share between -t and t, by the finite series in the angle."""
        angle = math.atan(t / math.sqrt(v))
        term, total = (math.cos(angle), 0.0) if n % 2 else (1.0, 0.0)
        for k in range(1 if n % 2 else 0, n - 1, 2):
            total += term
            term *= math.cos(angle) ** 2 * (k + 1) / (k + 2)
        return 2 / math.pi * (angle + math.sin(angle) * total) if n % 2 else math.sin(angle) * total

    low, high = 0.0, 1e6
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if within(mid) < 2 * share - 1 else (low, mid)
    return (low + high) / 2


def linear_prediction(df: DataFrame, key: str, x: str, y: str, share: float = 0.95) -> DataFrame:
    """key, x, mean, error, lower, upper: the least-squares line at each row's x, the standard error and the bounds of its mean, from one aggregation.

    Series of fewer than three points, or of one x, have no bounds.
    """
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(key, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    fit = rows.groupBy(F.col(key).alias("series")).agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"),
        F.avg("x").alias("centre"), F.regr_sxx("y", "x").alias("sxx"), F.regr_syy("y", "x").alias("syy"), F.regr_r2("y", "x").alias("r2"),
    )

    def quantile(n: pd.Series) -> pd.Series:
        return n.map({k: t_quantile((1 + share) / 2, k - 2) if k > 2 else None for k in n.unique()}).astype(float)

    fit = fit.withColumn("t", F.pandas_udf(quantile, "double")("n"))
    spread = F.sqrt(F.try_divide(F.col("syy") * (1 - F.coalesce("r2", F.lit(1.0))), F.col("n") - 2) * (1 / F.col("n") + F.try_divide((F.col("x") - F.col("centre")) ** 2, F.col("sxx"))))
    mean, width = F.col("intercept") + F.col("slope") * F.col("x"), F.when(~F.isnan("t"), F.col("t") * F.col("error"))
    met = rows.join(fit, F.col(key).eqNullSafe(F.col("series"))).withColumn("error", spread)
    return met.select(key, "x", mean.alias("mean"), "error", (mean - width).alias("lower"), (mean + width).alias("upper"))


#: Inverse link, its derivative by the linear term, and the variance by the mean.
FAMILIES = {
    "gaussian": (lambda e: e, np.ones_like, np.ones_like),
    "poisson": (np.exp, np.exp, lambda m: m),
    "gaussian_log": (np.exp, np.exp, np.ones_like),
    "gamma": (np.exp, np.exp, lambda m: m * m),
    "binomial": (lambda e: 1 / (1 + np.exp(-e)), lambda e: np.exp(-e) / (1 + np.exp(-e)) ** 2, lambda m: m * (1 - m)),
}


def _likelihood(family: str, y: np.ndarray, m: np.ndarray, scale: float) -> float:
    """The log likelihood; that of normal errors at their likeliest variance."""
    with np.errstate(divide="ignore", invalid="ignore"):
        if family == "poisson":
            return float(np.sum(y * np.log(m) - m - [math.lgamma(v + 1) for v in y]))
        if family == "binomial":
            return float(np.sum(np.where(y > 0, y * np.log(m), 0.0) + np.where(y < 1, (1 - y) * np.log(1 - m), 0.0)))
        if family == "gamma":
            return float(np.sum((np.log(y / (scale * m)) - y / m) / scale - np.log(y) - math.lgamma(1 / scale)))
        return -len(y) / 2 * (math.log(2 * math.pi * max(((y - m) ** 2).mean(), 1e-300)) + 1)


def fit_weighted(design: np.ndarray, y: np.ndarray, family: str, penalty: np.ndarray | None = None) -> dict:
    """Coefficients b by penalised, iteratively reweighted least squares, with their covariance, the parameters used, and aic and bic."""
    inverse, slope_of, variance = FAMILIES[family]
    ridge = np.zeros((design.shape[1],) * 2) if penalty is None else penalty
    if family == "binomial":
        m = (y + 0.5) / 2
        e = np.log(m / (1 - m))
    elif family == "gaussian":
        e = y.copy()
    else:
        e = np.log(np.maximum((y + y.mean()) / 2, 1e-6))
    b = None
    for _ in range(100):
        m, d = inverse(e), slope_of(e)
        w = d * d / np.maximum(variance(m), 1e-12)
        gram = (design.T * w) @ design
        new = np.linalg.lstsq(gram + ridge, (design.T * w) @ (e + (y - m) / d), rcond=None)[0]
        done = b is not None and np.abs(new - b).max() < 1e-10 * (1 + np.abs(new).max())
        b, e = new, np.clip(design @ new, -30, 30) if family != "gaussian" else design @ new
        if done or family == "gaussian":
            break
    m = inverse(e)
    bread = np.linalg.pinv(gram + ridge)
    used = float(np.trace(bread @ gram))
    scale = 1.0 if family in ("poisson", "binomial") else float(((y - m) ** 2 / variance(m)).sum() / max(len(y) - used, 1e-9))
    score = -2 * _likelihood(family, y, m, scale)
    return {"b": b, "mean": m, "cov": bread * scale, "used": used, "aic": score + 2 * used, "bic": score + math.log(len(y)) * used}


def bounded(design: np.ndarray, fit: dict, family: str, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, lower and upper bound at the rows of a design, normal on the scale of the link."""
    e = design @ fit["b"]
    width = NormalDist().inv_cdf((1 + share) / 2) * np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", design, fit["cov"], design), 0.0))
    return tuple(FAMILIES[family][0](v) for v in (e, e - width, e + width))


def _series(df: DataFrame, key: str, x: str, y: str) -> DataFrame:
    return df.select(F.col(key).cast("string").alias("key"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()


def _explained(y: np.ndarray, m: np.ndarray) -> float:
    whole, rest = ((y - y.mean()) ** 2).sum(), ((y - m) ** 2).sum()
    return float(1 - rest / whole) if whole else float(rest == 0)


def glm_trend(df: DataFrame, key: str, x: str, y: str, family: str = "poisson") -> DataFrame:
    """key, intercept, slope, r_squared, mse, aic, bic of a generalised linear model with a log or logit link, by reweighted least squares."""

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        t, target = rows["x"].to_numpy(float), rows["y"].to_numpy(float)
        got = fit_weighted(np.c_[np.ones(len(t)), t - t.min()], target, family)
        b = got["b"]
        row = [rows["key"].iloc[0], b[0] - b[1] * t.min(), b[1], _explained(target, got["mean"]), ((target - got["mean"]) ** 2).mean(), got["aic"], got["bic"]]
        return pd.DataFrame([row], columns=["key", "intercept", "slope", "r_squared", "mse", "aic", "bic"])

    schema = "key string, intercept double, slope double, r_squared double, mse double, aic double, bic double"
    return _series(df, key, x, y).groupBy("key").applyInPandas(fit, schema).withColumnRenamed("key", key)


def glm_prediction(df: DataFrame, key: str, x: str, y: str, family: str = "poisson", share: float = 0.95) -> DataFrame:
    """key, x, mean, lower, upper: the generalised linear model at each row's x and the bounds of its mean."""

    def predict(rows: pd.DataFrame) -> pd.DataFrame:
        t = rows["x"].to_numpy(float)
        design = np.c_[np.ones(len(t)), t - t.min()]
        mean, lower, upper = bounded(design, fit_weighted(design, rows["y"].to_numpy(float), family), family, share)
        return pd.DataFrame({"key": rows["key"], "x": t, "mean": mean, "lower": lower, "upper": upper})

    return _series(df, key, x, y).groupBy("key").applyInPandas(predict, "key string, x double, mean double, lower double, upper double").withColumnRenamed("key", key)


def bspline_basis(x: np.ndarray, knots: np.ndarray, degree: int) -> np.ndarray:
    """Values of all B-splines of a clamped knot vector."""
    last = np.searchsorted(knots, knots[-1]) - 1
    basis = np.array([(knots[i] <= x) & ((x < knots[i + 1]) | ((i == last) & (x == knots[-1]))) for i in range(len(knots) - 1)], float).T
    for d in range(1, degree + 1):
        parts = []
        for i in range(len(knots) - d - 1):
            left, right = knots[i + d] - knots[i], knots[i + d + 1] - knots[i + 1]
            a = (x - knots[i]) / left * basis[:, i] if left > 0 else np.zeros(len(x))
            b = (knots[i + d + 1] - x) / right * basis[:, i + 1] if right > 0 else np.zeros(len(x))
            parts.append(a + b)
        basis = np.array(parts).T
    return basis


def penalised_spline(df: DataFrame, key: str, x: str, y: str, dof: int = 20, degree: int = 3, alphas: tuple = (0.01, 0.1, 1.0, 10.0, 100.0)) -> DataFrame:
    """key, x, fitted: a smooth trend whose penalty has the least Akaike criterion."""

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("x")
        t, target = rows["x"].to_numpy(float), rows["y"].to_numpy(float)
        low, high = t[0], t[-1]
        if len(t) <= degree + 1 or high == low:
            return pd.DataFrame({"key": rows["key"], "x": t, "fitted": target})
        n = min(dof, len(t))
        inner = np.linspace(low, high, max(2, n - degree + 1))
        basis = bspline_basis(t, np.r_[[low] * degree, inner, [high] * degree], degree)
        bend = np.diff(np.eye(basis.shape[1]), 2, axis=0)
        best = None
        for alpha in alphas:
            hat = np.linalg.solve(basis.T @ basis + alpha * bend.T @ bend + 1e-9 * np.eye(basis.shape[1]), basis.T)
            fitted, used = basis @ (hat @ target), np.trace(basis @ hat)
            aic = len(t) * np.log(((target - fitted) ** 2).mean() + 1e-12) + 2 * used
            if best is None or aic < best[0]:
                best = aic, fitted
        return pd.DataFrame({"key": rows["key"], "x": t, "fitted": best[1]})

    rows = df.select(F.col(key).cast("string").alias("key"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    return rows.groupBy("key").applyInPandas(fit, "key string, x double, fitted double").withColumnRenamed("key", key)


#: Criteria of a search over penalties; all but the first two are means over folds.
CRITERIA = ("aic", "bic", "mse", "r_squared", "euclidean")
#: Penalties that are tried where none are given.
ALPHAS = tuple(float(a) for a in np.logspace(-6, 4, 100))


def fold(n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places to fit and to test: up to ten points each is left out once; longer series have five folds in order of time, each after all that it is fitted to."""
    if n <= 10:
        return np.delete(np.arange(n), k), np.array([k])
    size = n // 6
    start = n - (5 - k) * size
    return np.arange(start), np.arange(start, start + size)


def spline_fit(x: np.ndarray, y: np.ndarray, at: np.ndarray, alpha: float, family: str, low: float, high: float, dof: int = 20, degree: int = 3, share: float = 0.95) -> dict:
    """A penalised B-spline between two bounds, with mean, lower and upper at other places, aic and bic. Normal values are standardised."""
    knots = np.r_[[low] * degree, np.linspace(low, high, dof - degree + 1), [high] * degree]
    basis = bspline_basis(x, knots, degree)
    bend = np.diff(np.eye(basis.shape[1]), 2, axis=0)
    centre, spread = (y.mean(), y.std() or 1.0) if family == "gaussian" else (0.0, 1.0)
    fit = fit_weighted(basis, (y - centre) / spread, family, alpha * bend.T @ bend + 1e-9 * np.eye(basis.shape[1]))
    there = bounded(bspline_basis(np.clip(at, low, high), knots, degree), fit, family, share)
    return {name: v * spread + centre for name, v in zip(("mean", "lower", "upper"), there)} | {"aic": fit["aic"], "bic": fit["bic"]}


def spline_score(x: np.ndarray, y: np.ndarray, alpha: float, k: int, criterion: str, family: str, low: float, high: float, dof: int, degree: int) -> float:
    """What one penalty loses on one fold, less being better."""
    if criterion in ("aic", "bic"):
        return spline_fit(x, y, x[:1], alpha, family, low, high, dof, degree)[criterion]
    train, test = fold(len(x), k)
    mean = spline_fit(x[train], y[train], x[test], alpha, family, low, high, dof, degree)["mean"]
    if criterion == "r_squared":
        return -_explained(y[test], mean)
    return float(((y[test] - mean) ** 2).mean()) if criterion == "mse" else float(np.sqrt(((y[test] - mean) ** 2).sum()))


def spline_trend(
    df: DataFrame, key: str, x: str, y: str, criterion: str = "aic", family: str = "gaussian", alphas: tuple[float, ...] = ALPHAS,
    dof: int = 20, degree: int = 3, padding: float = 0.1, share: float = 0.95,
) -> DataFrame:
    """key, x, mean, lower, upper, alpha: a smooth trend whose penalty is the best of ``alphas`` by a criterion, the first of equals.

    A series is one row of two arrays, and each (series, penalty, fold) is a row of its own: the fits of one long search are dealt out
    over all tasks. Only the scores meet again, by series. Series of fewer than three points have no trend.
    """
    if criterion not in CRITERIA or family not in FAMILIES:
        raise ValueError("unknown criterion or family")
    lines = _series(df, key, x, y).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias("p")).where("size(p) > 2")
    lines = written(lines.select("key", F.col("p.x").alias("xs"), F.col("p.y").alias("ys")))
    tried = F.posexplode(F.array(*[F.lit(float(a)) for a in alphas])).alias("place", "alpha")
    folds = F.lit(1) if criterion in ("aic", "bic") else F.when(F.size("xs") <= 10, F.size("xs")).otherwise(5)
    tasks = lines.select("key", tried, folds.alias("folds")).withColumn("fold", F.explode(F.sequence(F.lit(0), F.col("folds") - 1)))
    tasks = tasks.repartition("key", "place", "fold").join(lines, "key")
    ends = lambda t: (t[0] - padding * (t[-1] - t[0]), t[-1] + padding * (t[-1] - t[0]) or 1.0)

    def score(xs: pd.Series, ys: pd.Series, alpha: pd.Series, fold_: pd.Series) -> pd.Series:
        return pd.Series([spline_score(t, v, a, k, criterion, family, *ends(t), dof, degree) for t, v, a, k in zip(xs, ys, alpha, fold_)])

    def predict(xs: pd.Series, ys: pd.Series, alpha: pd.Series) -> pd.DataFrame:
        each = [spline_fit(t, v, t, a, family, *ends(t), dof, degree, share) for t, v, a in zip(xs, ys, alpha)]
        return pd.DataFrame({name: [f[name] for f in each] for name in ("mean", "lower", "upper")})

    scored = tasks.withColumn("score", F.pandas_udf(score, "double")("xs", "ys", "alpha", "fold"))
    best = scored.groupBy("key", "place", "alpha").agg(F.avg("score").alias("score")).groupBy("key").agg(F.min_by("alpha", F.struct("score", "place")).alias("alpha"))
    fitted = lines.join(best, "key").withColumn("f", F.pandas_udf(predict, "mean array<double>, lower array<double>, upper array<double>")("xs", "ys", "alpha"))
    points = fitted.select("key", "alpha", F.explode(F.arrays_zip("xs", F.col("f.mean").alias("mean"), F.col("f.lower").alias("lower"), F.col("f.upper").alias("upper"))).alias("p"))
    return points.select(F.col("key").alias(key), F.col("p.xs").alias("x"), "p.mean", "p.lower", "p.upper", "alpha")


def smooth(df: DataFrame, key: str, x: str, y: str, resolution: int = 10, degree: int = 3, low: float | None = None, high: float | None = None) -> DataFrame:
    """key, x, y of an interpolating B-spline at ``resolution`` points a sample, clamped; a series with too few points is unchanged."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("x").drop_duplicates("x")
        t, v = rows["x"].to_numpy(float), rows["y"].to_numpy(float)
        if len(t) < degree + 1:
            return rows
        knots = np.r_[[t[0]] * (degree + 1), [t[i + 1 : i + degree + 1].mean() for i in range(len(t) - degree - 1)], [t[-1]] * (degree + 1)]
        weights = np.linalg.solve(bspline_basis(t, knots, degree), v)
        fine = np.linspace(t[0], t[-1], resolution * len(t))
        return pd.DataFrame({"key": rows["key"].iloc[0], "x": fine, "y": np.clip(bspline_basis(fine, knots, degree) @ weights, low, high)})

    rows = df.select(F.col(key).cast("string").alias("key"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    return rows.groupBy("key").applyInPandas(run, "key string, x double, y double").withColumnRenamed("key", key)
