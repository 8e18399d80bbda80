from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from ...common import write_out
from ..neighbours import Cells, distinct_vectors
from .base import Detector
from .local_outlier import attach


class KDE(Detector):
    """Minus the log of a Gaussian kernel density over all training rows."""

    def __init__(self, bandwidth: float = 1.0, seed: int = 42, **cells):
        self.bandwidth, self.seed, self.cells = bandwidth, seed, cells

    def fit(self, train: DataFrame) -> "KDE":
        self.index, self.own = Cells(train, self.seed, **self.cells), None
        return self

    def _own_sums(self) -> DataFrame | None:
        """(own, log_sum) of all training vectors by name, None if two of them have one name."""
        if self.own is None:
            named = self.index.locations.filter(F.col("loc").isNotNull())
            if not named.groupBy("loc").count().filter("count > 1").isEmpty():
                return None
            sums = self.index.own_log_kernel_sums(self.bandwidth).withColumnRenamed("loc", "own")
            self.own = write_out(sums, "own_sums")
        return self.own

    def score(self, rows: DataFrame) -> DataFrame:
        places = self.index.locations.select("vec", F.col("loc").alias("own"))
        queries = write_out(distinct_vectors(rows).withColumnRenamed("loc", "qid").join(places, "vec", "left"), "queries")
        # Vectors of the training set give each other their sums, which pays if many of them are asked for.
        known = queries.filter(F.col("own").isNotNull())
        own = self._own_sums() if 2 * known.count() >= self.index.size else None
        if own is None:
            sums = self.index.log_kernel_sum(queries.select("qid", "vec"), self.bandwidth)
        else:
            fresh = queries.filter(F.col("own").isNull()).select("qid", "vec")
            sums = known.select("qid", "own").join(own, "own").select("qid", "log_sum").unionByName(
                self.index.log_kernel_sum(fresh, self.bandwidth))
        dim = self.index.pivots.shape[1]
        norm = math.log(self.index.rows) + dim * math.log(self.bandwidth * math.sqrt(2 * math.pi))
        return attach(rows, queries, sums.select("qid", (F.lit(norm) - F.col("log_sum")).alias("score")))
