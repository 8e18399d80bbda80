"""Sharding by jump consistent hashing: stable keys map to shards without a ring table.

A key's 64-bit hash seeds a linear congruential generator whose draws say at which shard counts the key jumps to the
newest shard; the last jump below the shard count is its shard. Appending shards moves only the keys whose next jump
falls on a new one, n/(n+1) of them stay, and none moves between old shards. The shard depends on the key and the count
alone, so it is computed where a row is read and nothing is shuffled for it.

Slots number the rows of a shard without gaps in the order of a hash of the narrow row, bucket by bucket: bucket totals
first, then the rows inside a bucket, so that a shard is many tasks. Equal narrow rows are one counted group until the
end and take consecutive slots, so a repeated row costs one entry a task.

Defined results: the law is `key`: doc_id and the shard count decide, so rows of one id share a shard; a NULL id is a key of
its own. A NULL or empty text has size 1 and the checksum of no bytes, 0. Equal texts under different ids are placed by
their ids. Rows repeated with one id count one by one. An empty table gives an empty table. Columns named like an output
column are replaced, all others are carried along by `with_shard` and `write_shards`.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from lonetext.common import write_out

SHARDS = 8
FACTOR = 2862933555777941757  # of the generator of jump consistent hashing
BUCKET_DIGITS = 3  # hex digits of a narrow row's hash that name its bucket: 4096 buckets a shard
RUN = 4096  # equal rows that are numbered at a time


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key among `shards`."""
    state, at = keys.astype(np.uint64, copy=True), np.zeros(len(keys), np.int64)
    open_ = np.arange(len(keys))
    with np.errstate(over="ignore"):
        while len(open_):
            state[open_] = state[open_] * np.uint64(FACTOR) + np.uint64(1)
            draw = ((state[open_] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
            after = np.floor((at[open_] + 1) * (float(1 << 31) / draw))
            on = after < shards
            open_ = open_[on]
            at[open_] = after[on].astype(np.int64)
    return at.astype(np.int32)


def hash_of(key: str | Column) -> Column:
    """The first 64 bits of a key's md5, as a signed number; the same on every machine and in SQL."""
    key = F.col(key) if isinstance(key, str) else key
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(digest, 1, 16), 16, -10).cast("long")


def shard_of(key: str | Column, shards: int) -> Column:
    """The shard of a key, 0 to shards - 1."""
    if shards < 1:
        raise ValueError("at least one shard")

    @F.pandas_udf("int")
    def place(code: pd.Series) -> pd.Series:
        return pd.Series(jump(code.to_numpy(np.int64).view(np.uint64), shards))

    return place(hash_of(key))


def with_shard(docs: DataFrame, shards: int = SHARDS, key: str | Column = "doc_id", name: str = "shard") -> DataFrame:
    """All columns of `docs` and the shard of each row. No shuffle."""
    return docs.drop(name).withColumn(name, shard_of(key, shards))


def moved(docs: DataFrame, shards: int, grown: int, key: str | Column = "doc_id") -> DataFrame:
    """The rows whose shard changes when `shards` grow to `grown`, with `shard` and `grown_shard`."""
    if grown < shards:
        raise ValueError("shards are only appended")
    both = with_shard(with_shard(docs, shards, key), grown, key, "grown_shard")
    return both.filter("shard <> grown_shard")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, key: str | Column = "doc_id",
                 file_rows: int = 1_000_000) -> None:
    """Write `docs` as parquet in one folder per shard, files of at most `file_rows` rows.

    Each task writes the shards of its own rows, so texts are not shuffled and no shard is one task.
    """
    (with_shard(docs, shards, key).write.mode("errorifexists").option("maxRecordsPerFile", file_rows)
     .partitionBy("shard").parquet(path))


def numbered(rows: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    """`slot`: the place of each row within its `group`, from 0, in the order of a hash of `columns`.

    `rows` are narrow: `group` and `columns`, of which nothing else is kept.
    """
    text = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns])
    order = F.md5(text)
    counted = write_out(rows.groupBy(group, *columns).agg(F.count("*").alias("same")).withColumn("code", order)
                        .withColumn("bucket", F.substring("code", 1, BUCKET_DIGITS)), "shard-rows")
    sums = counted.groupBy(group, "bucket").agg(F.sum("same").alias("n"))
    earlier = Window.partitionBy(group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(group, "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    inside = Window.partitionBy(group, "bucket").orderBy("code", *columns).rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum("same").over(inside), F.lit(0))
    placed = counted.withColumn("inside", first).join(starts, [group, "bucket"])
    placed = placed.select(group, *columns, "same", (F.col("start") + F.col("inside")).alias("first"))
    # Equal rows are dealt out in runs, so that a row repeated very often is many short runs.
    runs = placed.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(same - 1) div {RUN}")))).hint("rebalance")
    step = F.sequence(F.col("run") * RUN, F.least("same", (F.col("run") + 1) * RUN) - 1)
    return runs.withColumn("step", F.explode(step)).select(
        group, *columns, (F.col("first") + F.col("step")).cast("long").alias("slot"))


def place(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every document."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    narrow = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
                         F.crc32(text).alias("text_crc32"))
    narrow = narrow.withColumn("shard", shard_of("doc_id", shards)).withColumn(
        "grown_shard", shard_of("doc_id", shards + 1))
    slots = numbered(narrow, "shard", ["doc_id", "size", "text_crc32", "grown_shard"])
    return slots.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
