"""Fitted nets and one-class SVMs as tables: weights in rows, scores by joins that any SQL engine can run."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from ...common import as_doubles, local_table

WEIGHTS = "layer int, i int, j int, w double"
# What a layer does with its sums.
ACTIVATIONS = {"linear": "{0}", "relu": "greatest({0}, 0)", "cos": "cos({0})"}


@dataclass
class StoredModel:
    """`rows` are (layer, i, j, w): w leads from value i of a layer's input to value j of its output, i = -1 is j's shift.

    The score is the last layer's only value (`value`), its squared length (`square`) or its length (`norm`); with
    `against` the output of that layer is subtracted before.
    """

    rows: list[tuple[int, int, int, float]]
    activations: Sequence[str]
    finish: str = "value"
    against: int | None = None

    def table(self, spark: SparkSession) -> DataFrame:
        return local_table(spark, self.rows, WEIGHTS)

    def sql(self, vectors: str = "vectors", weights: str = "weights") -> str:
        """(row_id, score) from `vectors` (row_id, i, x) and `weights`, in SQL that Spark and other engines share."""
        parts = [f"v0 AS (SELECT row_id, i, x FROM {vectors})"]
        for k, activation in enumerate(self.activations):
            value = ACTIVATIONS[activation].format("s.x + coalesce(b.w, 0)")
            parts.append(f"""s{k} AS (SELECT v.row_id, w.j AS i, sum(v.x * w.w) AS x FROM v{k} v
  JOIN {weights} w ON w.i = v.i AND w.layer = {k} GROUP BY v.row_id, w.j)""")
            parts.append(f"""v{k + 1} AS (SELECT s.row_id, s.i, {value} AS x FROM s{k} s
  LEFT JOIN {weights} b ON b.j = s.i AND b.layer = {k} AND b.i = -1)""")
        last = f"v{len(self.activations)}"
        score = {"value": "sum(o.x)", "square": "sum(o.x * o.x)", "norm": "sqrt(sum(o.x * o.x))"}[self.finish]
        source = f"{last} o"
        if self.against is not None:
            source = (f"(SELECT a.row_id, a.x - t.x AS x FROM {last} a JOIN v{self.against + 1} t "
                      "ON t.row_id = a.row_id AND t.i = a.i) o")
        return f"WITH {', '.join(parts)} SELECT o.row_id, {score} AS score FROM {source} GROUP BY o.row_id"

    def score(self, rows: DataFrame) -> DataFrame:
        """(row_id, score) of rows with unique ids, by joins."""
        spark = rows.sparkSession
        vectors = rows.select("row_id", F.posexplode(as_doubles("embedding")).alias("i", "x"))
        return spark.sql(self.sql("{vectors}", "{weights}"), vectors=vectors, weights=self.table(spark))


def scaling(mean: np.ndarray, scale: np.ndarray) -> list[tuple[int, int, int, float]]:
    """Layer 0 that standardises a vector."""
    return [row for i, (m, s) in enumerate(zip(mean.tolist(), scale.tolist()))
            for row in ((0, i, i, 1.0 / s), (0, -1, i, -m / s))]


def shifted(rows: list[tuple[int, int, int, float]], by: int) -> list[tuple[int, int, int, float]]:
    """The same layers further up."""
    return [(layer + by, i, j, w) for layer, i, j, w in rows]


def hidden_then_linear(n_layers: int) -> list[str]:
    return ["relu"] * (n_layers - 1) + ["linear"]
