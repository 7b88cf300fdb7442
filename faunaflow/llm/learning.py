"""Labels, their split, and a small logistic regression shared by the classifiers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows whose crc32 of the id, as text, leaves this remainder by 3 are held out.
HELD_OUT = 1


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == HELD_OUT, F.lit(False))


def training_labels(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """doc_id, label (0 or 1) of the rows to learn from; repeated ids by majority, ties as 1, nulls left out."""
    rows = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("double").alias("label")).where("doc_id is not null and label is not null")
    rows = rows.where(~held_out("doc_id"))
    return rows.groupBy("doc_id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))


def bounded(train: DataFrame, most: int) -> DataFrame:
    """About ``most`` labelled rows at most, drawn by a hash of the id."""
    n = train.count()
    if n <= most:
        return train
    return train.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * most / n))


class Logistic:
    """Ridge logistic regression on standardised columns, fitted by Newton steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0):
        self.mean, self.scale = (x.mean(0), x.std(0) + 1e-9) if len(x) else (0.0, 1.0)
        z = self._columns(x)
        self.w = np.zeros(z.shape[1])
        if 0 < y.sum() < len(y):
            penalty = np.r_[1e-6, np.full(z.shape[1] - 1, ridge)]
            for _ in range(50):
                p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
                step = np.linalg.solve((z.T * (p * (1 - p))) @ z + np.diag(penalty), z.T @ (y - p) - penalty * self.w)
                self.w += step
                if np.abs(step).max() < 1e-8:
                    break
        elif len(y):  # one class only: its smoothed rate
            rate = (y.sum() + 0.5) / (len(y) + 1)
            self.w[0] = np.log(rate / (1 - rate))

    def _columns(self, x: np.ndarray) -> np.ndarray:
        return np.c_[np.ones(len(x)), (x - self.mean) / self.scale]

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self._columns(x) @ self.w


def by_batch(function, series: Iterator) -> Iterator:
    import pandas as pd

    for part in series:
        yield pd.Series(function(part), dtype="float64")
