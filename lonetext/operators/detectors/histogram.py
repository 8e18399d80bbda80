from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from ...common import as_doubles
from .base import Detector, with_model


class HBOS(Detector):
    """Histogram-based outlier score (Goldstein and Dengel 2012): -sum over dimensions of log2(density + alpha).

    Equal-width bins; a value outside the fitted range by at most `tol` bin widths counts as the edge bin,
    farther out it gets the lowest value of the dimension.
    """

    def __init__(self, n_bins: int = 10, alpha: float = 0.1, tol: float = 0.5):
        self.n_bins, self.alpha, self.tol = n_bins, alpha, tol

    def fit(self, train: DataFrame) -> "HBOS":
        ranges = train.select(Summarizer.metrics("count", "min", "max")
                              .summary(array_to_vector(as_doubles("embedding"))).alias("m")).first().m
        n = ranges["count"]
        if not n:
            raise ValueError("no training rows")
        lo, hi = ranges["min"].toArray(), ranges["max"].toArray()
        flat = hi == lo
        self.lo = np.where(flat, lo - 0.5, lo)
        self.width = (np.where(flat, hi + 0.5, hi) - self.lo) / self.n_bins

        bins = F.transform(self._places(), lambda p: F.least(F.floor(p), F.lit(self.n_bins - 1)).cast("int"))
        # The outer form keeps Catalyst from testing for empty vectors first, which would compute them twice.
        counts = (with_model(train, lo=self.lo, width=self.width)
                  .select(F.posexplode_outer(bins).alias("dim", "bin")).groupBy("dim", "bin")
                  .agg(F.count("*").alias("n")).collect())
        density = np.zeros((len(lo), self.n_bins))
        for c in counts:
            density[c.dim, c.bin] = c.n / (n * self.width[c.dim])
        self.logs = np.log2(density + self.alpha)
        return self

    @staticmethod
    def _places() -> Column:
        """Position of each value in bin widths from the low end of its dimension."""
        above = F.zip_with(as_doubles("embedding"), F.col("model.lo"), lambda x, a: x - a)
        return F.zip_with(above, F.col("model.width"), lambda x, w: x / w)

    def score(self, rows: DataFrame) -> DataFrame:
        k = self.n_bins
        out = with_model(rows, lo=self.lo, width=self.width, logs=self.logs.ravel(), lowest=self.logs.min(1))

        def one(place, i):
            inside = F.greatest(F.least(F.floor(place), F.lit(k - 1)), F.lit(0)).cast("int")
            edge = (place >= -self.tol) & (place <= k + self.tol)
            return F.when(edge, F.get("model.logs", i * k + inside)).otherwise(F.get("model.lowest", i))

        total = F.aggregate(F.transform(self._places(), one), F.lit(0.0), lambda a, v: a + v)
        return out.withColumn("score", -total).drop("model")
