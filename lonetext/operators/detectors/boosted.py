from __future__ import annotations

from copy import copy

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from ...common import write_out
from .base import Detector, with_model, moments, standardised
from .forest import IsolationForest
from .local_outlier import LOF


def _settings(detector: Detector) -> tuple | None:
    """Kind and settings of a detector that is not fitted, None if they cannot be compared."""
    def plain(value: object) -> bool:
        return value is None or isinstance(value, (bool, int, float, str)) or (
            isinstance(value, dict) and all(map(plain, value.values())))

    own = dict(vars(detector))
    return (type(detector), own) if plain(own) else None


class XGBOD(Detector):
    """Boosted trees over the vector and the scores of unsupervised detectors (Zhao and Hryniewicki 2018)."""

    uses_labels = True

    def __init__(self, detectors: list[Detector] | None = None, max_iter: int = 100, max_depth: int = 3,
                 step_size: float = 0.1, seed: int = 42):
        self.detectors = detectors if detectors is not None else [LOF(seed=seed), IsolationForest(seed=seed)]
        self.max_iter, self.max_depth, self.step_size, self.seed = max_iter, max_depth, step_size, seed
        self.settings = [_settings(d) for d in self.detectors]
        self.adopted = False

    def adopt(self, other: Detector) -> None:
        """The moments and inner detectors, which see no labels, if the other's were made with the same settings."""
        if isinstance(other, XGBOD) and None not in self.settings and self.settings == other.settings:
            self.moments, self.detectors, self.adopted = other.moments, [copy(d) for d in other.detectors], True

    def fit(self, train: DataFrame) -> "XGBOD":
        if not self.adopted:
            self._learn(train)
        self.adopted = False  # fitted again, it learns from what it is given
        features = self._features(train).withColumn("target", F.col("y_semi").cast("double"))
        trees = GBTClassifier(featuresCol="features", labelCol="target", maxIter=self.max_iter,
                              maxDepth=self.max_depth, stepSize=self.step_size, seed=self.seed)
        self.model = trees.fit(write_out(features.select("row_id", features["embedding"], "features", "target"),
                                         "boosting").select("features", "target"))
        return self

    def _learn(self, train: DataFrame) -> None:
        """What needs no labels."""
        self.moments = moments(train)
        plain = self._plain(train)
        for detector in self.detectors:
            detector.fit(plain)

    def _plain(self, df: DataFrame) -> DataFrame:
        """Rows with standardised vectors, as the inner detectors see them."""
        out = with_model(df, mean=self.moments.mean, scale=self.moments.scale)
        return out.withColumn("embedding", standardised()).drop("model")

    def _features(self, df: DataFrame) -> DataFrame:
        """Add `features`: the standardised vector followed by each detector's score."""
        out, names = self._plain(df), []
        for i, detector in enumerate(self.detectors):
            names.append(f"_score{i}")
            out = detector.score(out).withColumnRenamed("score", names[-1])
        added = F.array(*names) if names else F.array().cast("array<double>")
        return out.withColumn("features", array_to_vector(F.concat("embedding", added)))

    def score(self, rows: DataFrame) -> DataFrame:
        kept = rows.withColumn("_original", F.col("embedding"))
        out = self.model.transform(self._features(kept)).withColumn("score", vector_to_array("probability")[1])
        return out.withColumn("embedding", F.col("_original")).select(*rows.columns, "score")
