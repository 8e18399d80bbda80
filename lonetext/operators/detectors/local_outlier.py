from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ...common import as_doubles, join_lookup, write_out
from ..candidates import HashTables
from ..neighbours import TIE_DECIMALS, Cells, distinct_vectors
from .base import Detector


class LOF(Detector):
    """Local outlier factor (Breunig et al. 2000), Euclidean: exact, or over the candidates of hash tables.

    Everything is computed per distinct vector: equal rows share distances, density and score, so a
    location of weight w stands for w neighbours. Scored rows meet the whole training set, so a training
    row is its own nearest neighbour; densities of the training set leave each row itself out.
    """

    def __init__(self, n_neighbors: int = 20, seed: int = 42, search: str = "exact", **index):
        """`search` is `exact` or `hash`; `index` are settings of `Cells` or `HashTables`."""
        if search not in ("exact", "hash"):
            raise ValueError(f"unknown search: {search}")
        self.n_neighbors, self.seed, self.search, self.settings = n_neighbors, seed, search, index

    def fit(self, train: DataFrame) -> "LOF":
        kind = HashTables if self.search == "hash" else Cells
        self.index = kind(train, self.seed, **self.settings)
        self.k = max(1, min(self.n_neighbors, self.index.rows - 1))
        queries = self.index.locations.withColumnRenamed("loc", "qid").drop("w")
        self.near = write_out(self.index.nearest(queries, self.k + 1), "neighbours")

        others = self._counted(self.near.withColumn("w", F.col("w") - (F.col("qid") == F.col("nbr")).cast("int")))
        reach = write_out(others.groupBy("qid").agg(F.max("d").alias("k_distance")), "k_distance")
        density = self._density(others, reach.withColumnRenamed("qid", "nbr"))
        self.fitted = write_out(density.join(reach, "qid").withColumnRenamed("qid", "nbr"), "lof")
        return self

    def _counted(self, near: DataFrame) -> DataFrame:
        """Add `used`: how many of the k nearest rows lie at each neighbouring location."""
        upto = F.sum("w").over(Window.partitionBy("qid").orderBy(F.round("d", TIE_DECIMALS), "nbr"))
        used = F.least(F.col("w"), F.lit(self.k) - (upto - F.col("w")))
        return near.withColumn("used", used).filter(F.col("used") > 0)

    def _density(self, counted: DataFrame, fitted: DataFrame) -> DataFrame:
        n = self.index.size * (self.k + 1)
        met = join_lookup(counted, fitted, "nbr", n)
        reach = F.sum(F.col("used") * F.greatest("k_distance", "d"))
        return met.groupBy("qid").agg((1.0 / (reach / self.k + 1e-10)).alias("density"))

    def score(self, rows: DataFrame) -> DataFrame:
        # Vectors of the training set were searched while fitting.
        places = self.index.locations.select("vec", F.col("loc").alias("own"))
        queries = write_out(distinct_vectors(rows).withColumnRenamed("loc", "qid").join(places, "vec", "left"),
                            "queries")
        known = (queries.filter(F.col("own").isNotNull()).select("qid", "own")
                 .join(self.near.filter(F.col("place") <= self.k).withColumnRenamed("qid", "own"), "own").drop("own"))
        fresh = self.index.nearest(queries.filter(F.col("own").isNull()).select("qid", "vec"), self.k)
        counted = write_out(self._counted(known.unionByName(fresh)), "neighbours")
        met = join_lookup(counted, self.fitted, "nbr", queries.count() * self.k)
        mean_reach = F.sum(F.col("used") * F.greatest("k_distance", "d")) / self.k
        mean_density = F.sum(F.col("used") * F.col("density")) / self.k
        found = met.groupBy("qid").agg((mean_density * (mean_reach + 1e-10)).alias("score"))
        return attach(rows, queries, found)


def attach(rows: DataFrame, queries: DataFrame, scores: DataFrame) -> DataFrame:
    """Give every row the score (qid, score) of its vector, `queries` being the distinct (qid, vec, w) of the rows.

    A vector shared by very many rows is matched by broadcast.
    """
    # Written, because a hot vector makes the join read the scores twice.
    scored = queries.select("qid", "vec").join(write_out(scores, "vector_scores"), "qid").select("vec", "score")
    keyed = rows.withColumn("vec", as_doubles("embedding"))
    return join_lookup(keyed, scored, "vec", counts=queries).drop("vec")
