from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ...common import matrix
from .base import Detector

NODES = "tree int, node int, feature int, threshold double, low int, high int, size int"


def mean_path(n):
    """Mean path length of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=np.float64)
    safe = np.maximum(n, 2.0)
    c = 2.0 * (np.log(safe - 1.0) + np.euler_gamma) - 2.0 * (safe - 1.0) / safe
    return np.where(n > 2, c, np.where(n == 2, 1.0, 0.0))


def draws(seed: int, tree: int, node: int) -> tuple[float, float]:
    """The two random numbers of a node, in [0, 1), from a hash of its name: any engine can repeat them."""
    digits = hashlib.md5(f"{seed}:{tree}:node:{node}".encode()).hexdigest()
    return int(digits[:8], 16) / 2.0 ** 32, int(digits[8:20], 16) / 2.0 ** 48


def _grow(pdf: pd.DataFrame, seed: int) -> pd.DataFrame:
    """Split one tree's sample at random until points are alone or the height limit is reached.

    Nodes are numbered as in a heap: the children of node n are 2n and 2n + 1.
    """
    tree = int(pdf["tree"].iloc[0])
    x = matrix(pdf["embedding"])
    limit = int(np.ceil(np.log2(max(len(x), 2))))
    nodes: list[list] = []
    todo = [(np.arange(len(x)), 0, 1, -1, 0)]
    while todo:
        idx, depth, name, parent, side = todo.pop()
        node = len(nodes)
        nodes.append([tree, node, -1, 0.0, -1, -1, len(idx)])
        if parent >= 0:
            nodes[parent][side] = node
        if depth >= limit or len(idx) <= 1:
            continue
        lo, hi = x[idx].min(0), x[idx].max(0)
        varied = np.flatnonzero(hi > lo)
        if not len(varied):
            continue
        which, where = draws(seed, tree, name)
        feature = int(varied[int(which * len(varied))])
        threshold = float(lo[feature] + where * (hi[feature] - lo[feature]))
        below = x[idx, feature] <= threshold
        nodes[node][2:4] = feature, threshold
        todo += [(idx[below], depth + 1, 2 * name, node, 4), (idx[~below], depth + 1, 2 * name + 1, node, 5)]
    return pd.DataFrame(nodes, columns=["tree", "node", "feature", "threshold", "low", "high", "size"])


class IsolationForest(Detector):
    """Isolation forest (Liu et al. 2008): 2^(-mean path / c(psi)) over trees grown on psi rows each."""

    def __init__(self, n_trees: int = 100, max_samples: int = 256, seed: int = 42):
        self.n_trees, self.max_samples, self.seed = n_trees, max_samples, seed

    def fit(self, train: DataFrame) -> "IsolationForest":
        n = train.count()
        if not n:
            raise ValueError("no training rows")
        self.psi = min(self.max_samples, n)
        surplus = 2.0
        nodes = self._nodes(train, surplus * self.psi / n)
        # A tree short of rows means the hash kept too few candidates: keep more.
        while (nodes[nodes["node"] == 0]["size"].to_numpy().tolist() != [self.psi] * self.n_trees):
            surplus *= 4
            nodes = self._nodes(train, surplus * self.psi / n)
        self.nodes = nodes
        return self

    def _nodes(self, train: DataFrame, share: float) -> pd.DataFrame:
        """All node rows of all trees, at most 2 * psi - 1 per tree."""
        def place(tree: Column) -> Column:
            return F.md5(F.concat_ws(":", F.lit(str(self.seed)), tree.cast("string"), F.lit("row"),
                                     F.col("row_id").cast("string")))

        trees = F.sequence(F.lit(0), F.lit(self.n_trees - 1))
        # Places are hexadecimal digits, so a share of them is those below a string.
        kept = F.filter(trees, lambda t: place(t) < f"{int(share * (1 << 48)):012x}") if share < 1 else trees
        candidates = train.select("row_id", "embedding", F.explode_outer(kept).alias("tree")).filter(
            F.col("tree").isNotNull()).withColumn("place", place(F.col("tree")))
        # Samples are small but growing a tree is work: keep trees in separate tasks.
        tasks = min(self.n_trees, train.sparkSession.sparkContext.defaultParallelism * 2)
        candidates = candidates.repartition(tasks, "tree")
        rank = F.row_number().over(Window.partitionBy("tree").orderBy("place", "row_id"))
        sample = candidates.withColumn("rank", rank).filter(F.col("rank") <= self.psi).drop("rank")
        seed_value = self.seed
        grown = sample.groupBy("tree").applyInPandas(lambda pdf: _grow(pdf, seed_value), NODES)
        return grown.toPandas().sort_values(["tree", "node"], ignore_index=True)

    def score(self, rows: DataFrame, uncertainty: bool = False) -> DataFrame:
        """Add `score`, and with `uncertainty` the spread over trees of the normalised path length."""
        first = np.flatnonzero(self.nodes["node"].to_numpy() == 0)
        base = np.repeat(first, np.diff([*first, len(self.nodes)]))
        feature = self.nodes["feature"].to_numpy()
        model = rows.sparkSession.sparkContext.broadcast((
            first, feature, self.nodes["threshold"].to_numpy(), self.nodes["low"].to_numpy() + base,
            self.nodes["high"].to_numpy() + base, mean_path(self.nodes["size"].to_numpy()), float(mean_path(self.psi))))

        @F.pandas_udf("score double, uncertainty double")
        def walk(embedding: pd.Series) -> pd.DataFrame:
            first, feature, threshold, low, high, rest, norm = model.value
            x = matrix(embedding)
            at = np.tile(first, (len(x), 1))
            depth = np.zeros(at.shape)
            row = np.arange(len(x))[:, None]
            while True:
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                below = x[row, np.maximum(f, 0)] <= threshold[at]
                at = np.where(inner, np.where(below, low[at], high[at]), at)
                depth += inner
            paths = (depth + rest[at]) / (norm or 1.0)
            return pd.DataFrame({"score": 2.0 ** -paths.mean(1), "uncertainty": paths.std(1)})

        walked = rows.withColumn("_w", walk("embedding")).withColumn("score", F.col("_w.score"))
        if uncertainty:
            walked = walked.withColumn("uncertainty", F.col("_w.uncertainty"))
        return walked.drop("_w")
