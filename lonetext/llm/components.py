"""Connected components of a table of links, as Spark jobs that only ever hold narrow tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lonetext.common import write_out


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of `links` (a, b); the component is its smallest node.

    Every round takes the smallest label among a node and its neighbours and then the label of that label, so paths
    shrink by half; links whose ends agree are dropped. A hub is summed up before the shuffle.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = write_out(both.filter("a <> b").distinct(), "cc-links")
    labels = write_out(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")),
                       "cc-labels")
    while True:
        other = labels.select(F.col("node").alias("b"), F.col("component").alias("other"))
        near = both.join(other, "b").groupBy(F.col("a").alias("node")).agg(F.min("other").alias("near"))
        better = labels.join(near, "node").select("node", F.least("component", "near").alias("component"),
                                                  F.col("component").alias("old"))
        better = write_out(better, "cc-step")
        up = better.select(F.col("node").alias("component"), F.col("component").alias("above"))
        jumped = better.join(up, "component").select("node", F.least("component", "above").alias("component"), "old")
        jumped = write_out(jumped, "cc-labels")
        labels = jumped.drop("old")
        if jumped.filter("component <> old").isEmpty():
            return labels
