"""Exact, seeded picks of k rows per group, and the samplers and splitters built on them.

A row's place is md5(seed:row_id). The k-th smallest place of a group is found from counts per hash
prefix plus a ranking of the one prefix that holds it; rows are then compared with that single value,
so wide rows (texts, vectors) are never shuffled or sorted.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..common import join_null_safe, local_table, write_out
from .ranges import with_rank

PREFIX_DIGITS = 4


def hash_place(seed: int | Column, row_id: str) -> Column:
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    return F.md5(F.concat_ws(":", seed.cast("string"), F.col(row_id).cast("string")))


def normal_and_anomalous(df: DataFrame, y: str) -> tuple[int, int]:
    """Rows with y = 0 and with y = 1."""
    return tuple(df.agg(F.count_if(F.col(y) == 0), F.count_if(F.col(y) == 1)).first())


def class_sizes(df: DataFrame, by: str) -> DataFrame:
    """(by, n): the rows of every class, as a table of any length."""
    return write_out(df.groupBy(by).agg(F.count("*").alias("n")), "class_sizes")


def _last_places(df: DataFrame, by: Sequence[str], quotas: Sequence[tuple] | DataFrame, row_id: str,
                 seed: int | Column) -> DataFrame:
    """(by..., _last): the place of the k-th row of each group in `quotas`, as a table of values."""
    wanted = quotas
    if not isinstance(quotas, DataFrame):
        fields = [T.StructField(c, df.schema[c].dataType) for c in by]
        wanted = local_table(df.sparkSession, quotas, T.StructType([*fields, T.StructField("_k", T.LongType())]))

    keyed = df.select(*by, F.col(row_id).alias("_id"), hash_place(seed, row_id).alias("_h"))
    keyed = keyed.withColumn("_p", F.substring("_h", 1, PREFIX_DIGITS))
    runs = join_null_safe(keyed.groupBy(*by, "_p").agg(F.count("*").alias("_n")), wanted, by)
    upto = F.sum("_n").over(Window.partitionBy(*by).orderBy("_p"))
    edge = (runs.withColumn("_upto", upto)
            .filter((F.col("_upto") >= F.col("_k")) & (F.col("_upto") - F.col("_n") < F.col("_k")))
            .select(*by, "_p", (F.col("_k") - F.col("_upto") + F.col("_n")).alias("_rest")))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("_h", "_id"))
    last = (join_null_safe(keyed, edge, [*by, "_p"]).withColumn("_r", rank)
            .filter(F.col("_r") == F.col("_rest"))
            .select(*by, F.struct("_h", "_id").alias("_last")))
    # One value per quota, found once: later steps compare against values, not against a nested plan.
    return write_out(last, "last_places")


def _flag(df: DataFrame, by: Sequence[str], last: DataFrame, row_id: str, seed: int | Column, flag: str) -> DataFrame:
    within = F.struct(hash_place(seed, row_id).alias("_h"), F.col(row_id).alias("_id")) <= F.col("_last")
    flagged = join_null_safe(df, last, by, "left")
    return flagged.withColumn(flag, F.when(F.col("_last").isNull(), False).otherwise(within)).drop("_last")


def flag_picked(df: DataFrame, by: Sequence[str], quotas: Sequence[tuple] | DataFrame, row_id: str = "row_id",
                seed: int | Column = 42, flag: str = "picked") -> DataFrame:
    """Add a boolean that is true for exactly k rows of each group in `quotas`: (group..., k), or a table with _k.

    Groups without a quota get none. A quota must not exceed its group.
    """
    return _flag(df, by, _last_places(df, by, quotas, row_id, seed), row_id, seed, flag)


def proportional_quotas(sizes: DataFrame, by: str, total: int) -> DataFrame:
    """(by, _k): `total` shared over the classes (by, n) by largest remainder; equal remainders go to the smaller class.

    The two windows run over one narrow row per class.
    """
    whole = Window.partitionBy(F.lit(0))
    product = F.col("n").cast("decimal(19,0)") * F.lit(total).cast("decimal(19,0)")
    n = F.sum("n").over(whole)
    rest = (product % n).alias("_rest")
    shared = sizes.select(by, ((product - product % n) / n).cast("long").alias("_floor"), rest)
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("_rest"), F.asc_nulls_first(by)))
    extra = (rank <= F.lit(total) - F.sum("_floor").over(whole)).cast("long")
    return shared.select(by, (F.col("_floor") + extra).alias("_k"))


def head_sample(df: DataFrame, max_samples: int, row_id: str = "row_id") -> DataFrame:
    """The `max_samples` smallest ids, the order a keyless file has implicitly; ids are numbers and occur once.

    The last id that belongs is found by counts over ranges of ids; the rows are then a filter on it, which reaches
    the scan, and are never sorted.
    """
    if max_samples <= 0:
        return df.limit(0)
    ranked = with_rank(df.select(F.lit(0).alias("_all"), row_id), ["_all"], row_id, "_rank")
    last = ranked.filter(F.col("_rank") == max_samples - 1).first()
    return df if last is None else df.filter(F.col(row_id) <= last[row_id])


def stratified_sample(df: DataFrame, max_samples: int, label: str = "label",
                      row_id: str = "row_id", seed: int = 42) -> DataFrame:
    """Exactly `max_samples` rows with the class shares of the input; smaller inputs pass unchanged."""
    sizes = class_sizes(df, label)
    if (sizes.agg(F.sum("n")).first()[0] or 0) <= max_samples:
        return df
    quotas = proportional_quotas(sizes, label, max_samples)
    return flag_picked(df, [label], quotas, row_id, seed).filter("picked").drop("picked")


def sample_rows(df: DataFrame, max_samples: int, strategy: str = "stratified", **kwargs) -> DataFrame:
    if strategy == "head":
        return head_sample(df, max_samples, kwargs.get("row_id", "row_id"))
    if strategy == "stratified":
        return stratified_sample(df, max_samples, **kwargs)
    raise ValueError(f"unknown sampling strategy: {strategy}")


def adjust_contamination(df: DataFrame, share: float = 0.05, seed: int = 42, y: str = "y",
                         row_id: str = "row_id") -> DataFrame:
    """Keep every normal row and exactly int(normals * share) anomalies."""
    normal, anomalous = normal_and_anomalous(df, y)
    wanted = int(normal * share)
    if wanted > anomalous:
        raise ValueError(f"not enough anomalies: {wanted} wanted, {anomalous} present")
    flagged = flag_picked(df, [y], [(1, wanted)], row_id, seed)
    return flagged.filter((F.col(y) == 0) | F.col("picked")).drop("picked")


def stratified_split(df: DataFrame, test_size: float = 0.2, seed: int = 42, y: str = "y",
                     row_id: str = "row_id") -> DataFrame:
    """Add `split`: ceil(test_size * n) rows are 'test', classes shared out in proportion."""
    sizes = class_sizes(df, y)
    n, least, classes = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.min("n"), F.count("*")).first()
    if classes and least < 2:
        raise ValueError("a class with fewer than two rows cannot be split")
    n_test = ceil(test_size * n)
    if min(n_test, n - n_test) < classes:
        raise ValueError(f"{n_test} test and {n - n_test} train rows for {classes} classes")
    quotas = proportional_quotas(sizes, y, n - n_test)
    flagged = flag_picked(df, [y], quotas, row_id, seed)
    return flagged.withColumn("split", F.when(F.col("picked"), "train").otherwise("test")).drop("picked")


def known_quota(n_rows: int, n_outliers: int, n_known: int | None, contamination: float | None) -> int:
    """How many outliers get their label revealed; a count wins over a share of the rows."""
    if n_known is not None:
        return min(n_known, n_outliers)
    if contamination is not None:
        return min(int(contamination * n_rows), n_outliers)
    raise ValueError("give n_known or contamination")


def partial_labels(df: DataFrame, n_known: int | None = None, contamination: float | None = None,
                   seed: int = 42, y: str = "y", row_id: str = "row_id") -> DataFrame:
    """Add `y_semi`: 1 for the outliers whose label is known, 0 for everything else."""
    if n_known is None and contamination is None:
        raise ValueError("give n_known or contamination")
    normal, anomalous = normal_and_anomalous(df, y)
    k = known_quota(normal + anomalous, anomalous, n_known, contamination)
    flagged = flag_picked(df, [y], [(1, k)], row_id, seed)
    return flagged.withColumn("y_semi", F.col("picked").cast("int")).drop("picked")


def _scenarios(df: DataFrame, levels: Sequence[float], n_rounds: int, y: str,
               row_id: str) -> tuple[DataFrame, list[tuple]]:
    """(row_id, y) repeated per level and round, and the quota of each scenario."""
    normal, n_out = normal_and_anomalous(df, y)
    n_rows = normal + n_out
    scenarios = [(float(c), r) for c in levels for r in range(n_rounds)]
    quotas = [(1, c, r, known_quota(n_rows, n_out, None, c)) for c, r in scenarios]
    grid = F.array(*[F.struct(F.lit(c).alias("contamination"), F.lit(r).alias("round")) for c, r in scenarios])
    return df.select(F.col(row_id), F.col(y), F.inline(grid)), quotas


def partial_labels_grid(df: DataFrame, levels: Sequence[float], n_rounds: int, seed: int = 42,
                        y: str = "y", row_id: str = "row_id") -> DataFrame:
    """(row_id, y, contamination, round, y_semi) for every level and round, in one job.

    Rounds differ by seed + round, so within a round a lower level's labels are part of a higher one's.
    """
    long, quotas = _scenarios(df, levels, n_rounds, y, row_id)
    flagged = flag_picked(long, [y, "contamination", "round"], quotas, row_id, F.lit(seed) + F.col("round"))
    return flagged.withColumn("y_semi", F.col("picked").cast("int")).drop("picked")


def partial_labels_per_scenario(df: DataFrame, levels: Sequence[float], n_rounds: int, seed: int = 42, y: str = "y",
                                row_id: str = "row_id") -> tuple[DataFrame, dict[tuple[float, int], int]]:
    """The rows with `semi`, an array with a `y_semi` for every level and round, and the place of each in it.

    The cuts of all scenarios are found in one job; the rows are compared with them as values, in one pass.
    """
    long, quotas = _scenarios(df, levels, n_rounds, y, row_id)
    outliers = long.filter(F.col(y) == 1)
    last = _last_places(outliers, [y, "contamination", "round"], quotas, row_id, F.lit(seed) + F.col("round"))
    cuts = {(r.contamination, r["round"]): r["_last"] for r in last.collect()}  # one value per scenario
    marks, places = [], {}
    for _, level, r, _ in quotas:
        places[level, r] = len(marks)
        cut = cuts.get((level, r))
        if cut is None:
            marks.append(F.lit(0))
            continue
        mine = F.struct(hash_place(seed + r, row_id).alias("_h"), F.col(row_id).alias("_id"))
        edge = F.struct(F.lit(cut["_h"]).alias("_h"), F.lit(cut["_id"]).cast(df.schema[row_id].dataType).alias("_id"))
        marks.append(F.when((F.col(y) == 1) & (mine <= edge), 1).otherwise(0))
    return df.withColumn("semi", F.array(*marks)), places
