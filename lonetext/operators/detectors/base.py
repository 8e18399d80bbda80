from __future__ import annotations

from abc import ABC, abstractmethod
from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from ...common import as_doubles, local_table


class Detector(ABC):
    """Input rows: row_id, embedding, and y_semi for detectors with `uses_labels`."""

    uses_labels = False

    @abstractmethod
    def fit(self, train: DataFrame) -> "Detector": ...

    @abstractmethod
    def score(self, rows: DataFrame) -> DataFrame: ...

    def adopt(self, other: "Detector") -> None:
        """Take over what `other`, fitted on the same vectors, learned without labels. Here that is nothing."""


@dataclass
class Moments:
    n: int
    mean: np.ndarray
    variance: np.ndarray  # population

    @property
    def scale(self) -> np.ndarray:
        """Standard deviations, 1 for constant dimensions."""
        return np.where(self.variance > 1e-24, np.sqrt(self.variance), 1.0)


def moments(df: DataFrame, embedding: str = "embedding") -> Moments:
    """Mean and variance per dimension in one aggregate."""
    vec = array_to_vector(as_doubles(embedding))
    row = df.select(Summarizer.metrics("count", "mean", "variance").summary(vec).alias("m")).first().m
    n = row["count"]
    if not n:
        raise ValueError("no training rows")
    return Moments(n, row["mean"].toArray(), row["variance"].toArray() * (n - 1) / n)


def with_model(df: DataFrame, **values) -> DataFrame:
    """Add fitted arrays as one struct column `model`, filled by a scalar subquery: no join, no long literal."""
    fields = {k: np.asarray(v, dtype=np.float64).tolist() for k, v in values.items()}
    schema = ", ".join(f"{k} array<double>" for k in fields)
    table = local_table(df.sparkSession, [tuple(fields.values())], schema)
    return df.withColumn("model", table.select(F.struct(*fields)).scalar())


def standardised(embedding: str = "embedding", mean: str = "model.mean", scale: str = "model.scale") -> Column:
    centred = F.zip_with(as_doubles(embedding), F.col(mean), lambda x, m: x - m)
    return F.zip_with(centred, F.col(scale), lambda x, s: x / s)
