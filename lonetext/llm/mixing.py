"""Mixing sources to target weights along a curriculum whose source weights change over the course of training.

Every source has a weight schedule: straight lines between knots over training time 0 to 1. Its integral up to time t,
as a share of the whole, times the source's token target is the demand up to t. A source's documents, in a seeded
order and repeated when the target is above its size, form a stream of tokens; the stretch a document fills in that
stream gets the time at which demand reaches its middle, found by inverting the integral. All stretches of all sources
are then range-sorted by that time.

Defined results: NULL texts and texts without words have size 0, take nothing, have no position and come last. A NULL
source is a source of its own, last in order. Rows repeated with one id count one by one. An empty table gives an empty
table. Columns named like an output column are replaced, all others are carried along (names that start with mix_ are
refused).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from lonetext.common import local_table, write_out
from lonetext.llm.words import slices, split, texts_of

Schedule = Sequence[tuple[float, float]]

# The source weights by rank, repeating, and the curriculum of each: the heavy sources grow, the light ones fade.
WEIGHTS = (5, 2, 1)
SCHEDULES: tuple[Schedule, ...] = (
    ((0.0, 0.5), (0.6, 1.0), (1.0, 2.0)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 2.0), (0.5, 1.0), (1.0, 0.5)))
CAP = 3
BUCKET_ROWS = 500  # rows of a source per bucket of its seeded order
BUCKETS = 1 << 16


def with_size(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """`docs` with `size`, the words of the text, and with or without the text."""
    names = [c for c in docs.columns if c != "size" and (keep_text or c != "text")]
    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField("size", T.LongType())])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words, bounds = split(texts_of(part))
                sizes = np.diff(bounds)
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(c)) for c in names]
                                                 + [pa.array(sizes, pa.int64())], [*names, "size"])

    return docs.select(*dict.fromkeys([*names, "text"])).mapInArrow(count, schema)


def targets(sized: DataFrame, weights: Sequence[float] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """One row per source: its size, row count and token target.

    The sizes of all sources together are dealt out by weight. A target stops at `cap` times its source's size and the
    excess goes to the others by weight. In the order of cap * size / weight the capped sources come first, so the
    level (words per weight) of the others follows from running sums; it is the level at the first source not capped. The windows run over one narrow row per source.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("rank", rank).withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                               (F.col("rank") % len(weights) + 1).cast("int")))
    order = Window.orderBy(F.col("source_size") * cap / F.col("weight"), "rank")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy(F.lit(1))
    level = ((F.sum("source_size").over(whole) - F.coalesce(F.sum(F.col("source_size") * cap).over(before), F.lit(0)))
             / F.sum("weight").over(after))
    leveled = per.withColumn("level", level)
    free = F.col("source_size") * cap >= F.col("level") * F.col("weight")
    common = F.max(F.when(free, F.col("level"))).over(whole)
    return leveled.withColumn("common", common).select(
        "source", "source_size", "n_rows", "rank",
        F.least(F.col("source_size").cast("double") * cap, F.col("common") * F.col("weight")).alias("target"))


def integral(knots: Schedule) -> tuple[list[tuple[float, ...]], float]:
    """Pieces (start, end, weight at the start, slope, integral before) of a schedule, and its whole integral."""
    if knots[0][0] != 0 or knots[-1][0] != 1 or any(a[0] >= b[0] for a, b in zip(knots, knots[1:])):
        raise ValueError("knots run from 0 to 1 in order")
    if any(w < 0 for _, w in knots) or not any(w > 0 for _, w in knots):
        raise ValueError("weights are not negative and not all zero")
    area, pieces = 0.0, []
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        pieces.append((t0, t1, w0, (w1 - w0) / (t1 - t0), area))
        area += (w0 + w1) / 2 * (t1 - t0)
    return pieces, area


def curriculum(spark: SparkSession, schedules: Sequence[Schedule] = SCHEDULES) -> DataFrame:
    """The integrals of the schedules as a table, one row each."""
    rows = [(i, *integral(knots)) for i, knots in enumerate(schedules)]
    kind = "array<struct<t0: double, t1: double, w0: double, slope: double, area: double>>"
    return local_table(spark, [(i, [dict(zip(("t0", "t1", "w0", "slope", "area"), p)) for p in ps], a)
                               for i, ps, a in rows], f"schedule int, pieces {kind}, whole double")


def time_of(share: Column, pieces: Column, whole: Column) -> Column:
    """The time at which the integral of a schedule reaches `share` of its whole."""
    goal = share * whole
    piece = F.element_at(F.filter(pieces, lambda p: (p["area"] <= goal) | (p["t0"] == 0)), -1)
    left = goal - piece["area"]
    # w0 * x + slope / 2 * x^2 = left, in the form that is stable for small slopes
    root = F.sqrt(F.greatest(piece["w0"] * piece["w0"] + 2 * piece["slope"] * left, F.lit(0.0)))
    step = F.when(left <= 0, F.lit(0.0)).otherwise(2 * left / (piece["w0"] + root))
    return F.least(piece["t0"] + step, piece["t1"])


def mix(rows: DataFrame, weights: Sequence[float] = WEIGHTS, schedules: Sequence[Schedule] = SCHEDULES,
        cap: int = CAP, seed: int = 0, narrow: DataFrame | None = None) -> DataFrame:
    """Add source_size, target, taken, position and occurrences to rows that have doc_id, source and size, sorted.

    `occurrences` lists (pass, taken, position) of every time the document is used; the last one of a source stops
    where its target is reached. `position` is the first. A source's order is cut into buckets by hash, so that a
    source that holds much of the rows is many tasks: bucket totals are added up first, then the rows of a bucket.
    """
    spark = rows.sparkSession
    rows = rows.drop("source_size", "target", "taken", "position", "occurrences")
    if any(c.startswith("mix_") for c in rows.columns):
        raise ValueError("column names that start with mix_ are reserved")
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string")))
    place = F.conv(F.substring(key, 1, 4), 16, 10).cast("int")
    narrow = rows.select("doc_id", "source", "size") if narrow is None else narrow
    bucket = F.floor(F.col("mix_place") * F.least(F.ceil(F.col("mix_rows") / BUCKET_ROWS), F.lit(BUCKETS)) / BUCKETS)
    per = targets(narrow, weights, cap).withColumn("schedule", (F.col("rank") % len(schedules)).cast("int"))
    per = per.join(F.broadcast(curriculum(spark, schedules)), "schedule").select(
        F.col("source").alias("mix_source"), "source_size", "target", F.col("n_rows").alias("mix_rows"),
        F.col("pieces").alias("mix_pieces"), F.col("whole").alias("mix_whole"))
    per = write_out(per, "mix-sources")

    def keyed(df: DataFrame) -> DataFrame:
        joined = df.join(per, df["source"].eqNullSafe(per["mix_source"]))
        return joined.withColumn("mix_place", place).withColumn("mix_bucket", bucket.cast("int"))

    sums = keyed(narrow).groupBy("mix_source", "mix_bucket").agg(F.sum("size").alias("mix_words"))
    earlier = Window.partitionBy("mix_source").orderBy("mix_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col("mix_source").alias("mix_s"), F.col("mix_bucket").alias("mix_b"),
                         F.coalesce(F.sum("mix_words").over(earlier), F.lit(0)).alias("mix_start"))
    starts = write_out(starts, "mix-starts")
    inside = Window.partitionBy("mix_source", "mix_bucket").orderBy(key, "size")
    inside = inside.rowsBetween(Window.unboundedPreceding, -1)
    placed = (keyed(rows).withColumn("mix_inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
              .join(starts, F.col("mix_source").eqNullSafe(F.col("mix_s")) & (F.col("mix_bucket") == F.col("mix_b"))))
    start = F.col("mix_start") + F.col("mix_inside")
    goal = F.floor("target")

    def used(p: Column) -> Column:
        begin = p * F.col("source_size") + start
        taken = F.greatest(F.lit(0), F.least(F.col("size"), goal - begin))
        share = (begin + taken / 2) / F.nullif(F.col("target"), F.lit(0.0))
        return F.struct(p.alias("pass"), taken.cast("long").alias("taken"),
                        time_of(share, F.col("mix_pieces"), F.col("mix_whole")).alias("position"))

    every = F.filter(F.transform(F.sequence(F.lit(0), F.lit(cap - 1)), used), lambda o: o["taken"] > 0)
    return placed.withColumn("occurrences", every).select(
        *rows.columns, "source_size", "target",
        F.aggregate("occurrences", F.lit(0).cast("long"), lambda a, o: a + o["taken"]).alias("taken"),
        F.when(F.size("occurrences") > 0, F.col("occurrences")[0]["position"]).alias("position"), "occurrences")


def sort_by_position(mixed: DataFrame) -> DataFrame:
    """Range-sort by training position; the written table keeps the sort's sampling from computing the mix again."""
    return write_out(mixed, "mix").orderBy(F.col("position").asc_nulls_last(), F.col("doc_id"))
