"""Multiclass labels recast as normal / anomaly, and the summaries printed along the way."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def majority_label(df: DataFrame, label: str = "label") -> DataFrame:
    """One row: the most frequent label; a tie goes to the smallest."""
    return (df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
            .orderBy(F.desc("n"), F.asc(label)).limit(1).select(label))


def label_binary(df: DataFrame, label: str = "label", normal_label=None) -> DataFrame:
    """Add `y`: 0 for the normal class (majority unless named, or any of a list), 1 for all else, NULL labels included.

    The majority is looked up once and enters the plan as a value, so later passes do not count the labels again.
    """
    if normal_label is None:
        found = majority_label(df, label).first()
        if found is None:
            return df.withColumn("y", F.lit(1))
        normal_label = found[0]
    several = isinstance(normal_label, (list, tuple, set, frozenset))
    normal = F.col(label).isin(list(normal_label)) if several else F.col(label) == F.lit(normal_label)
    return df.withColumn("y", F.when(normal, 0).otherwise(1))


def class_report(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows per label and the part the label plays; a row each, however many labels there are."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    role = F.when(F.col(label) == majority_label(df, label).scalar(), "normal").otherwise("anomaly")
    return counts.withColumn("role", role)


def data_summary(df: DataFrame, y: str = "y", embedding: str = "embedding") -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"), F.max(F.size(embedding)).alias("dim"),
                  F.coalesce(F.sum(y), F.lit(0)).alias("n_anomalies"),
                  F.coalesce(F.sum(1 - F.col(y)), F.lit(0)).alias("n_normal"),
                  F.avg(y).alias("share_anomalies"))


def split_summary(df: DataFrame, by: Sequence[str] = ("split",), y: str = "y") -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n_rows"), F.sum(y).alias("n_outliers"),
                               F.sum(1 - F.col(y)).alias("n_inliers"))
