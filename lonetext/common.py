"""Helpers shared by every operator: written tables, checked small tables, joins on hot keys."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

# Keys that hold at least this many rows are matched by broadcast, at most so many of them.
HOT_KEYS = 1_000
HOT_ROWS = 1_000_000

_local_scratch: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: `spark.checkpoint.dir`, or a temp folder in local mode only."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_scratch:
        _local_scratch[app] = tempfile.mkdtemp(prefix="lonetext-")
    return _local_scratch[app]


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        package = os.path.dirname(os.path.abspath(__file__))
        base = os.path.join(tempfile.mkdtemp(prefix="lonetext-"), "lonetext")
        root, name = os.path.split(package)
        spark.sparkContext.addPyFile(shutil.make_archive(base, "zip", root, name))
        _shipped.add(app)


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


_owned: list[list[str]] = []


@contextmanager
def owned_tables(spark: SparkSession) -> Iterator[None]:
    """Tables that `write_out` writes inside are dropped at the end, but for those written with `keep`."""
    paths: list[str] = []
    _owned.append(paths)
    try:
        yield
    finally:
        _owned.remove(paths)
        for path in paths:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def write_out(df: DataFrame, name: str, partition_by: Sequence[str] = (), keep: bool = False) -> DataFrame:
    """Write `df` to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    if _owned and not keep:
        _owned[-1].append(path)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """Write `df` to the shared folder in `buckets` hash buckets of `key` and read it back, one file per bucket.

    Grouping or joining the result by `key` reads the buckets where they are: the rows are shuffled once, here.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    if _owned:
        _owned[-1].append(path)
    table = "lonetext_" + uuid.uuid4().hex
    (df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path)
     .format("parquet").saveAsTable(table))
    return spark.table(table)


def local_table(spark: SparkSession, rows: Iterable[Sequence], schema: T.StructType | str) -> DataFrame:
    """A driver-made table as a local relation (no job to scan it)."""
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    rows = [tuple(r) for r in rows]
    if not rows:
        return spark.createDataFrame([], schema)
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    columns = [pa.array([r[i] for r in rows], type=f.type) for i, f in enumerate(arrow)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=arrow), schema=schema)


def collect_bounded(df: DataFrame, limit: int, what: str) -> list:
    """Collect an aggregate whose size must not grow with the rows; fail loudly when it does."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what}: more than {limit} rows")
    return rows


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on `keys` where NULL matches NULL; the right side's key columns are dropped."""
    renamed = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return left.join(renamed, on, how).drop(*[f"__{k}" for k in keys])


def join_lookup(rows: DataFrame, lookup: DataFrame, key: str, n_rows: int | None = None,
                counts: DataFrame | None = None, hot_rows: int = HOT_ROWS, hot_keys: int = HOT_KEYS) -> DataFrame:
    """Inner join of `rows` to a lookup with one row per key, where one key may hold much of `rows`.

    The `hot_keys` most frequent keys (of at least `hot_rows` rows) are matched by broadcast, at most
    `hot_keys` lookup rows; every other key holds less than 1/hot_keys of the rows and is shuffled.
    `counts` (key, w) saves counting the rows per key, `n_rows` under `hot_rows` saves looking at all.
    """
    if n_rows is not None and n_rows < hot_rows:
        return rows.join(lookup, key)
    if counts is None:
        counts = rows.groupBy(key).agg(F.count("*").alias("w"))
    hot = counts.filter(F.col("w") >= hot_rows).orderBy(F.desc("w"), key).limit(hot_keys).select(key)
    found = hot.collect()
    if not found:
        return rows.join(lookup, key)
    keys = local_table(rows.sparkSession, found, hot.schema)
    hot_lookup = lookup.join(F.broadcast(keys), key, "left_semi")
    on_hot = rows.join(F.broadcast(hot_lookup), key)
    on_rest = rows.join(F.broadcast(keys), key, "left_anti").join(lookup, key)
    return on_hot.unionByName(on_rest)


def as_doubles(column: str | Column) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return column.cast("array<double>")


def matrix(series: pd.Series) -> np.ndarray:
    """An Arrow batch of vectors as one double matrix."""
    return np.vstack(series.to_numpy()).astype(np.float64, copy=False)
