from __future__ import annotations

import numpy as np
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from .base import Detector, with_model, moments, standardised


class PCADetector(Detector):
    """Squared length along the principal axes, each divided by its variance (Shyu et al. 2003)."""

    def __init__(self, n_components: int | None = None, floor: float = 1e-9):
        self.n_components, self.floor = n_components, floor

    def fit(self, train: DataFrame) -> "PCADetector":
        self.moments = moments(train)
        dim = len(self.moments.mean)
        k = self.n_components or dim
        model = PCA(k=k, inputCol="features", outputCol="projected").fit(self._features(train).select("features"))
        n = self.moments.n
        total = float((self.moments.variance > 1e-24).sum()) * n / max(n - 1, 1)
        self.variances = np.asarray(model.explainedVariance.toArray()) * total
        self.model = model
        return self

    def _features(self, df: DataFrame) -> DataFrame:
        out = with_model(df, mean=self.moments.mean, scale=self.moments.scale)
        return out.withColumn("features", array_to_vector(standardised())).drop("model")

    def score(self, rows: DataFrame) -> DataFrame:
        # Axes without variance carry no information and are left out.
        weight = np.where(self.variances > self.floor, 1.0 / np.maximum(self.variances, self.floor), 0.0)
        projected = with_model(self.model.transform(self._features(rows)), weight=weight)
        terms = F.zip_with(vector_to_array("projected"), F.col("model.weight"), lambda p, w: p * p * w)
        total = F.aggregate(terms, F.lit(0.0), lambda a, v: a + v)
        return projected.withColumn("score", total).drop("features", "projected", "model")
