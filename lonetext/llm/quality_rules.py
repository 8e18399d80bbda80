"""Quality rules: base rules on counts, and robust multivariate outliers per language and source.

Each text gives counts, and the counts a vector of transformed statistics. For every stratum (a language and a source)
the minimum-covariance-determinant estimate of location and scatter is found over all its rows by concentration steps:
from the coordinate medians, the half of the rows with the smallest distances gives the next mean and covariance, until
these stay the same. Each step is one grouped aggregate over a narrow table. A row is rejected when its
Mahalanobis distance from its stratum's estimate, after the usual reweighting step, is above a chi-square quantile.

The order of the distances is cut by a histogram of their logarithm (4096 bins a stratum), never by sorting a stratum,
and statistics are whole multiples of 1/1024, so that sums are exact and results do not depend on partitioning.

Defined results: a NULL or empty text has no words and fails the base rules; such rows take no part in the estimates.
NULL languages and sources are values of their own. Strata with fewer than `MIN_ROWS` usable rows are pooled per
language, then altogether; where even that is too few, only the base rules decide. Repeated rows count one by one.
Columns other than doc_id, text, lang and source are left out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from lonetext.common import write_out
from lonetext.llm.words import coded, owners, slices, split, texts_of, totals

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

UNIT = 1024  # statistics are whole multiples of 1 / UNIT
NAMES = ("length", "symbols", "lines", "repeats", "stutter")
DIM = len(NAMES)
# The least standard deviation of each statistic: most texts have no symbols and no repeats at all, and a scatter
# estimate of zero would reject any that has one.
FLOOR = (0.12, 0.02, 0.1, 0.05, 0.05)
MIN_ROWS = 100
SHARE = 0.75  # of a stratum's rows in the concentration steps
STEPS = 6  # at most; steps stop when no stratum's subset changes its size or sums
BINS = 4096
CUTOFF = 30.86  # chi-square quantile 0.99999 with 5 degrees of freedom
# Of the central SHARE of normal rows: their covariance is too small by this factor (5 dimensions, 0.75).
CONSISTENCY = 1.41
REWEIGHT = 12.83  # chi-square quantile 0.975: rows within it make the final estimate

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_stutters",)  # words equal to the word before


def repeated_words(ids: np.ndarray, bounds: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """Per text the words in a window of `width` words that the text has twice or more.

    A repeated window consists of repeated pairs. Pairs that occur twice in a text are numbered, and only windows
    whose pairs all have a number are compared, four pair numbers at a time.
    """
    n_texts = len(bounds) - 1
    result = np.zeros(n_texts, np.int64)
    if len(ids) < 2:
        return result
    owner = owners(bounds)
    size = int(ids.max()) + 1
    key = (owner[:-1] * size + ids[:-1]) * size + ids[1:]
    key = np.where(owner[:-1] == owner[1:], key, -1 - np.arange(len(key)))
    rank = _repeated(key)
    steps = range(0, width - 1, 2)
    last = len(ids) - width + 1
    if last <= 0:
        return result
    whole = owner[:last] == owner[width - 1:width - 1 + last]
    for step in steps:
        whole &= rank[step:step + last] >= 0
    at = np.flatnonzero(whole)
    code = rank[at]
    for step in list(steps)[1:]:
        code = np.unique(code * (int(rank.max()) + 1) + rank[at + step], return_inverse=True)[1]
    hit = at[_repeated(code) >= 0]
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + width, -1)
    return totals((np.cumsum(edge)[:-1] > 0).astype(np.int64), bounds)


def _repeated(key: np.ndarray) -> np.ndarray:
    """Numbers for values that occur twice or more, -1 for the others."""
    if not len(key):
        return np.empty(0, np.int64)
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    run = np.cumsum(new) - 1
    many = np.bincount(run)[run] > 1
    rank = np.full(len(key), -1, np.int64)
    rank[order[many]] = run[many]
    return rank


def duplicate_lines(texts: pa.Array) -> np.ndarray:
    """Per text the lines with a word that equal an earlier line."""
    lists = pc.split_pattern(texts, "\n")
    bounds = lists.offsets.to_numpy().astype(np.int64)
    bounds, lines = bounds - bounds[0], lists.flatten()
    ids, distinct = coded(lines)
    full = pc.greater(pc.binary_length(pc.ascii_trim_whitespace(distinct)), 0).to_numpy(zero_copy_only=False)
    full = full[ids] if len(ids) else np.zeros(0, bool)
    owner = owners(bounds)[full]
    first = np.unique(owner * (len(distinct) + 1) + ids[full])
    size = len(bounds) - 1
    return np.bincount(owner, minlength=size) - np.bincount(first // (len(distinct) + 1), minlength=size)


def with_counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang and source of `docs`, with the counts."""
    names = ["doc_id", "lang", "source"]
    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField(c, T.LongType()) for c in (*COUNTS, *MORE)])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = texts_of(part)
                words, bounds = split(texts)
                ids, _ = coded(words)
                length = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
                symbols = pc.count_substring_regex(texts, "[#*$%&|<>]").to_numpy(zero_copy_only=False)
                again = np.concatenate([[False], (ids[1:] == ids[:-1])]) if len(ids) else np.zeros(0, bool)
                again[bounds[:-1][np.diff(bounds) > 0]] = False
                values = (np.diff(bounds), totals(length, bounds), symbols, duplicate_lines(texts),
                          repeated_words(ids, bounds), totals(again.astype(np.int64), bounds))
                yield pa.RecordBatch.from_arrays(
                    [part.column(part.schema.get_field_index(c)) for c in names]
                    + [pa.array(v, pa.int64()) for v in values], [*names, *COUNTS, *MORE])

    return docs.select(*names, "text").mapInArrow(count, schema)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def statistics() -> list[Column]:
    """The transformed statistics, as whole multiples of 1 / UNIT."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    values = (F.log(F.greatest(F.col("word_chars") / words, F.lit(0.1))),
              F.log1p(F.col("n_symbols") / words), F.log1p(8 * F.col("n_dup_lines") / words),
              F.col("n_repeat_words") / words, F.col("n_stutters") / words)
    return [F.round(v * UNIT).cast("double").alias(f"x{i}") for i, v in enumerate(values)]


PAIRS = [(i, j) for i in range(DIM) for j in range(i, DIM)]


def _moments(rows: DataFrame) -> DataFrame:
    return rows.groupBy("stratum").agg(
        F.count("*").alias("n"), *[F.sum(f"x{i}").alias(f"s{i}") for i in range(DIM)],
        *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}_{j}") for i, j in PAIRS])


_ESTIMATE = ("stratum string, " + ", ".join(f"m{i} double" for i in range(DIM)) + ", "
             + ", ".join(f"p{i}_{j} double" for i, j in PAIRS))


def _estimate(moments: DataFrame, factor: float) -> DataFrame:
    """Centre and precision matrix of every stratum from its sums; each variance is raised to its floor."""
    floor = np.square(np.array(FLOOR))

    def invert(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            n = frame["n"].to_numpy(float)
            mean = np.stack([frame[f"s{i}"] / n for i in range(DIM)], axis=1)
            scatter = np.empty((len(frame), DIM, DIM))
            for i, j in PAIRS:
                scatter[:, i, j] = scatter[:, j, i] = (frame[f"s{i}_{j}"] / n - mean[:, i] * mean[:, j]) / UNIT ** 2
            scatter *= factor
            lack = np.maximum(floor - np.diagonal(scatter, axis1=1, axis2=2), 0)
            scatter[:, range(DIM), range(DIM)] += lack + 1e-9
            inverse = np.linalg.inv(scatter)
            out = {"stratum": frame["stratum"], **{f"m{i}": mean[:, i] for i in range(DIM)},
                   **{f"p{i}_{j}": inverse[:, i, j] for i, j in PAIRS}}
            yield pd.DataFrame(out)

    return write_out(moments.mapInPandas(invert, _ESTIMATE), "mcd-estimate")


def _with_distance(rows: DataFrame, estimate: DataFrame, how: str = "inner") -> DataFrame:
    delta = [(F.col(f"x{i}") - F.col(f"m{i}")) / UNIT for i in range(DIM)]
    square = sum(((1 if i == j else 2) * F.col(f"p{i}_{j}") * delta[i] * delta[j] for i, j in PAIRS), F.lit(0.0))
    gone = [f"m{i}" for i in range(DIM)] + [f"p{i}_{j}" for i, j in PAIRS]
    return rows.join(estimate, "stratum", how).withColumn("distance", square).drop(*gone)


def _bin() -> Column:
    """Bins of the logarithm of the squared distance, from 1e-6 to 1e6."""
    place = (F.log10(F.greatest(F.col("distance"), F.lit(1e-6))) + 6) / 12 * BINS
    return F.least(F.floor(place), F.lit(BINS - 1)).cast("int")


def _central(rows: DataFrame, share: float) -> DataFrame:
    """The rows of each stratum in the bins that hold its `share` smallest distances."""
    binned = rows.withColumn("bin", _bin())
    counts = binned.groupBy("stratum", "bin").agg(F.count("*").alias("k"))
    running = Window.partitionBy("stratum").orderBy("bin")
    whole = Window.partitionBy("stratum")
    cut = (counts.withColumn("upto", F.sum("k").over(running)).withColumn("all", F.sum("k").over(whole))
           .filter(F.col("upto") >= F.ceil(F.col("all") * share)).groupBy("stratum").agg(F.min("bin").alias("last")))
    return binned.join(write_out(cut, "mcd-cut"), "stratum").filter(F.col("bin") <= F.col("last"))


def fit(rows: DataFrame, share: float = SHARE, steps: int = STEPS) -> DataFrame:
    """Location and precision of every stratum of a narrow table (stratum, x0, x1, ...)."""
    at = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    quartiles = rows.groupBy("stratum").agg(*[F.percentile(f"x{i}", at).alias(f"q{i}") for i in range(DIM)])
    spread = [F.greatest((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / (1.349 * UNIT), F.lit(FLOOR[i])) for i in range(DIM)]
    estimate = write_out(quartiles.select(
        "stratum", *[F.col(f"q{i}")[1].alias(f"m{i}") for i in range(DIM)],
        *[(1 / (spread[i] * spread[i]) if i == j else F.lit(0.0)).alias(f"p{i}_{j}") for i, j in PAIRS]), "mcd-start")
    names = [f"m{i}" for i in range(DIM)] + [f"p{i}_{j}" for i, j in PAIRS]
    for _ in range(steps):
        last, estimate = estimate, _estimate(_moments(_central(_with_distance(rows, estimate), share)), CONSISTENCY)
        old = last.select("stratum", *[F.col(c).alias(f"old_{c}") for c in names])
        moved = sum((F.abs(F.col(c) - F.col(f"old_{c}")) for c in names), F.lit(0.0))
        if (estimate.join(old, "stratum").agg(F.max(moved)).first()[0] or 0.0) < 1e-9:
            break
    return _estimate(_moments(_with_distance(rows, estimate).filter(F.col("distance") <= REWEIGHT)), 1.0)


def strata(counted: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """Language and source to stratum; strata with too few usable rows are pooled, NULL where all are too few."""
    usable = counted.filter(~base_failed()).groupBy("lang", "source").agg(F.count("*").alias("n"))
    shown = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("null"))
    small = F.col("n") < min_rows
    per_lang = F.sum(F.when(small, F.col("n"))).over(Window.partitionBy("lang"))
    first = usable.withColumn("pool", F.when(~small, F.lit(0)).when(per_lang >= min_rows, 1).otherwise(2))
    rest = F.sum(F.when(F.col("pool") == 2, F.col("n"))).over(Window.partitionBy(F.lit(1)))
    name = (F.when(F.col("pool") == 0, F.concat_ws("/", F.lit("s"), shown("lang"), shown("source")))
            .when(F.col("pool") == 1, F.concat_ws("/", F.lit("l"), shown("lang")))
            .when(rest >= min_rows, F.lit("rest")))
    return first.select(F.col("lang").alias("k_lang"), F.col("source").alias("k_source"), name.alias("stratum"))


def judge(docs: DataFrame, cutoff: float = CUTOFF, share: float = SHARE, steps: int = STEPS,
          min_rows: int = MIN_ROWS) -> DataFrame:
    """doc_id, lang, source, the counts, base_failed, stratum, distance and kept of every document."""
    counted = write_out(with_counts(docs), "quality-counts")
    groups = write_out(strata(counted, min_rows), "quality-strata")
    joined = counted.join(groups, counted["lang"].eqNullSafe(groups["k_lang"])
                          & counted["source"].eqNullSafe(groups["k_source"]), "left").drop("k_lang", "k_source")
    joined = joined.select("*", base_failed().alias("base_failed"), *statistics())
    xs = [f"x{i}" for i in range(DIM)]
    rows = joined.filter(~F.col("base_failed") & F.col("stratum").isNotNull()).select("stratum", *xs)
    estimate = fit(write_out(rows, "quality-vectors"), share, steps)
    result = _with_distance(joined, estimate, "left").drop(*xs)
    return result.withColumn("kept", ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cutoff))
