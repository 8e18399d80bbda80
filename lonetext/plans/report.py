"""The tables behind the plots: score distributions and metric curves."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..common import join_null_safe


def class_name(y: str = "y") -> Column:
    return F.when(F.col(y) == 0, "Normal").otherwise("Anomaly")


def score_histogram(scored: DataFrame, n_bins: int = 30, y: str = "y", score: str = "score") -> DataFrame:
    """(label, bin, lo, hi, n, density): bins shared by the classes, density normalised per class."""
    rows = scored.select(class_name(y).alias("label"), F.col(score).cast("double").alias("s"))
    span = rows.agg(F.struct(F.min("s").alias("lo"), F.max("s").alias("hi")).alias("span")).scalar()
    width = F.when(span["hi"] > span["lo"], (span["hi"] - span["lo"]) / n_bins).otherwise(1.0 / n_bins)
    low = F.when(span["hi"] > span["lo"], span["lo"]).otherwise(span["lo"] - 0.5)
    counts = (rows.withColumn("bin", F.least(F.floor((F.col("s") - low) / width), F.lit(n_bins - 1)).cast("int"))
              .groupBy("label", "bin").agg(F.count("*").alias("n")))
    totals = rows.groupBy("label").agg(F.count("*").alias("total"))  # two classes
    return (counts.join(F.broadcast(totals), "label")
            .select("label", "bin", (low + F.col("bin") * width).alias("lo"),
                    (low + (F.col("bin") + 1) * width).alias("hi"), "n",
                    (F.col("n") / (F.col("total") * width)).alias("density")))


def score_density(scored: DataFrame, n_points: int = 200, y: str = "y", score: str = "score") -> DataFrame:
    """(label, point, x, density): Gaussian kernel curve per class, Scott bandwidth, from its lowest to highest score.

    Every row adds to each point of its class's grid; partial sums leave a task as one row per point.
    """
    rows = scored.select(class_name(y).alias("label"), F.col(score).cast("double").alias("s"))
    stats = (rows.groupBy("label").agg(F.count("*").alias("n"), F.min("s").alias("lo"), F.max("s").alias("hi"),
                                       F.stddev_samp("s").alias("sd"))
             .filter((F.col("n") > 1) & (F.col("sd") > 0))
             .withColumn("bw", F.col("sd") * F.pow(F.col("n"), F.lit(-0.2))))
    x = F.col("lo") + F.col("point") * (F.col("hi") - F.col("lo")) / (n_points - 1)
    z = (F.col("x") - F.col("s")) / F.col("bw")
    points = F.explode(F.sequence(F.lit(0), F.lit(n_points - 1))).alias("point")
    return (rows.join(F.broadcast(stats), "label").select("*", points).withColumn("x", x)
            .groupBy("label", "point").agg(
                F.first("x").alias("x"),
                (F.sum(F.exp(-0.5 * z * z)) / (F.first("n") * F.first("bw") * F.sqrt(2 * F.pi()))).alias("density")))


REPLICATES = 1_000
ROW = ("run_id", "model", "dataset", "round")
# Distribution function of the Poisson law with mean 1 at 0, 1, 2, ...: a uniform number's weight is how many it reaches.
POISSON = tuple(sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(12))


def poisson_weight(replicate: str, row: Sequence[str], seed: int) -> Column:
    """How often a row counts in a replicate, 0, 1, 2, ...: drawn from the md5 of replicate and row, so it is repeatable."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(replicate).cast("string"),
                               *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in row]))
    uniform = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)
    return F.get(F.transform(F.array(uniform), lambda u: sum((u >= F.lit(p)).cast("int") for p in POISSON)), F.lit(0))


def bootstrap_interval(rows: DataFrame, keys: Sequence[str], value: str, row: Sequence[str] = ROW,
                       replicates: int = REPLICATES, level: float = 0.95, seed: int = 42) -> DataFrame:
    """(keys..., lo, hi): the percentile interval of the mean of `value` over bootstrap replicates.

    Every row weighs in each replicate by a Poisson draw, so all replicates of all groups are one aggregate whose tasks
    add up before the shuffle. A replicate in which no row counts is left out. Rows that agree in `row` share their draws.
    """
    each = rows.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    weighed = each.withColumn("times", poisson_weight("replicate", row, seed))
    means = weighed.groupBy(*keys, "replicate").agg(
        (F.sum(F.col("times") * F.col(value)) / F.nullif(F.sum("times"), F.lit(0))).alias("mean"))
    tails = [(1 - level) / 2, (1 + level) / 2]
    return means.groupBy(*keys).agg(F.percentile("mean", tails[0]).alias("lo"), F.percentile("mean", tails[1]).alias("hi"))


def _curve(results: DataFrame, x: str, metric: str, interval: str) -> DataFrame:
    rows = results.filter(F.col(metric).isNotNull())
    keys = ["model", "dataset", x]
    curve = rows.groupBy(*keys).agg(F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("sd"),
                                    F.count(metric).alias("n"))
    if interval == "normal":
        half = 1.96 * F.col("sd") / F.sqrt("n")
        return curve.withColumn("lo", F.col("mean") - half).withColumn("hi", F.col("mean") + half)
    if interval != "bootstrap":
        raise ValueError(f"unknown interval: {interval}")
    ends = join_null_safe(curve, bootstrap_interval(rows, keys, metric), keys)
    return ends.withColumns({c: F.when(F.col("n") > 1, F.col(c)) for c in ("lo", "hi")})


def curve_known(results: DataFrame, metric: str = "test_auc", sort: bool = False,
                interval: str = "bootstrap") -> DataFrame:
    """Mean metric and a 95 % interval by number of known outliers; a single row has no interval.

    The interval is the bootstrap's, or with `interval='normal'` 1.96 standard errors to either side.
    """
    curve = _curve(results, "n_known_outliers", metric, interval)
    return curve.orderBy("model", "dataset", "n_known_outliers") if sort else curve


def curve_percent(results: DataFrame, metric: str = "test_auc", sort: bool = False,
                  interval: str = "bootstrap") -> DataFrame:
    """The same by percentage of the training rows that are known outliers."""
    percent = 100 * F.col("n_known_outliers") / F.col("train_size")
    curve = _curve(results.withColumn("labeled_percentage", percent), "labeled_percentage", metric, interval)
    return curve.orderBy("model", "dataset", "labeled_percentage") if sort else curve
