"""Hard-negative mining by segment summaries: bounds on scores from means and deviations, refined before exact scoring.

Vectors are whole numbers, cut into segments. With each segment's mean and deviation stored, the inner product of two
vectors lies within the sum over segments of length * (mean * mean -/+ deviation * deviation). Segments halve from level
to level, so bounds tighten; only rows that could still be among an anchor's answers go on to the next level and, at the
end, to exact scoring.

Rows stay where they are read. Anchors meet them block by block: a block is a bounded broadcast, one job finds the
positives of its anchors in all rows and one job the negatives. A task keeps each anchor's best answers only, and Spark
merges the tasks' answers per anchor. Labels are never grouped, so a label that holds most rows is no hot key.

Defined results: rows with a NULL label, a NULL or empty vector, or a component that is NULL, NaN or infinite take no
part, nor do vectors whose squared length exceeds a long, so that every score fits one. Vectors of different lengths do not meet. A row is no partner of an anchor with
its id; a NULL id is no anchor, comes last among ties, and can be a partner. Rows repeated with one id count one by one,
as partners and as anchors. Without same-label rows an anchor has no answers; without rows within the margin an
(anchor, positive) pair has none. An empty table gives an empty table. Further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from lonetext.common import as_doubles, write_out

SCALE = 256
EXACT = 1 << 52  # squared lengths up to here: scores are exact whole numbers as doubles
LEVELS = (1, 2, 4, 8, 16)  # segments of a vector, from coarse to fine
POSITIVES = 5
NEGATIVES = 5
MARGIN = (80, 100)  # a negative's score as per cent of the positive's
BLOCK = 8192  # anchors that meet the rows at a time
SLICE = 4096  # rows of a task that meet the anchors at a time
LAST = np.iinfo(np.int64).max  # stands for a NULL id, which comes last


# --- summaries -------------------------------------------------------------------------------------------------------

def cuts(dim: int, segments: int) -> np.ndarray:
    return np.arange(segments + 1) * dim // segments


def summaries(x: np.ndarray, segments: int = LEVELS[-1]) -> tuple[np.ndarray, np.ndarray]:
    """Mean and standard deviation of every segment of every row; an empty segment has 0."""
    at = cuts(x.shape[1], segments)
    mean, deviation = np.zeros((2, len(x), segments))
    for s in range(segments):
        part = x[:, at[s]:at[s + 1]]
        if part.shape[1]:
            mean[:, s], deviation[:, s] = part.mean(axis=1), part.std(axis=1)
    return mean, deviation


def coarser(mean: np.ndarray, deviation: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Summaries of segments twice as long."""
    n = length.reshape(-1, 2)
    whole = n.sum(axis=1)
    weight = n / np.maximum(whole, 1)[:, None]
    m, d = mean.reshape(len(mean), -1, 2), deviation.reshape(len(mean), -1, 2)
    joint = (m * weight).sum(axis=2)
    square = ((d * d + (m - joint[:, :, None]) ** 2) * weight).sum(axis=2)
    return joint, np.sqrt(square), whole


class Summary:
    """Means and deviations of some vectors at every level, both scaled so that bounds are plain products."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, dim: int):
        length = np.diff(cuts(dim, LEVELS[-1]))
        found = {LEVELS[-1]: (mean, deviation, length)}
        for level in reversed(LEVELS[:-1]):
            found[level] = coarser(*found[2 * level])
        self.levels = [(m * np.sqrt(n), d * np.sqrt(n)) for m, d, n in (found[k] for k in LEVELS)]
        self.norm = np.sqrt((self.levels[-1][0] ** 2 + self.levels[-1][1] ** 2).sum(axis=1))

    def bounds(self, level: int, some: np.ndarray, other: "Summary", i: int) -> tuple[np.ndarray, np.ndarray]:
        """Least and most of the scores of rows `some` with row i of another summary."""
        (mean, deviation), (m, d) = self.levels[level], other.levels[level]
        middle, spread = mean[some] @ m[i], deviation[some] @ d[i]
        room = 1e-9 * self.norm[some] * other.norm[i] + 1e-6  # for rounding
        return middle - spread - room, middle + spread + room


def prepared(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """(row, vec_id, label, dim, vector, mean, deviation) of the rows that take part; the last three are binary."""
    vector = as_doubles("embedding")
    fit = F.forall(F.coalesce(vector, F.array()), lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    used = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
                       vector.alias("v"), fit.alias("fit")).filter(F.col("label").isNotNull() & (F.size("v") > 0) & F.col("fit"))
    used = used.drop("fit")

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            flat = batch.column(2).flatten().to_numpy()
            bounds = np.concatenate([[0], np.cumsum(np.diff(batch.column(2).offsets.to_numpy()))])
            vectors, means, deviations = [b""] * batch.num_rows, [b""] * batch.num_rows, [b""] * batch.num_rows
            dims = np.diff(bounds)
            square = np.add.reduceat(np.floor(scale * flat) ** 2, bounds[:-1]) if len(dims) else np.empty(0)
            keep = square < 2.0 ** 63
            for dim in np.unique(dims).tolist():
                own = np.flatnonzero((dims == dim) & keep)
                x = np.floor(scale * flat[bounds[own][:, None] + np.arange(dim)])
                mean, deviation = summaries(x)
                for at, i in enumerate(own.tolist()):
                    vectors[i], means[i], deviations[i] = x[at].astype("<i8").tobytes(), mean[at].tobytes(), deviation[at].tobytes()
            number = pa.array(np.arange(row, row + batch.num_rows))
            row += batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [number, batch.column(0), batch.column(1), pa.array(dims, pa.int32()), pa.array(vectors, pa.binary()),
                 pa.array(means, pa.binary()), pa.array(deviations, pa.binary())],
                ["row", "vec_id", "label", "dim", "vector", "mean", "deviation"]).filter(pa.array(keep))

    return used.mapInArrow(build, "row long, vec_id long, label long, dim int, vector binary, mean binary, deviation binary")


class Block:
    """Rows of one vector length as arrays."""

    def __init__(self, row: np.ndarray, vec_id: np.ndarray, label: np.ndarray, dim: int, vector: list[bytes],
                 mean: list[bytes], deviation: list[bytes]):
        self.row, self.id, self.label, self.dim = row, vec_id, label, dim
        self.whole = np.frombuffer(b"".join(vector), "<i8").reshape(len(row), dim)
        self.double = self.whole.astype(np.float64)
        self.small = bool(((self.double ** 2).sum(axis=1) < EXACT).all())
        parts = [np.frombuffer(b"".join(p)).reshape(len(row), LEVELS[-1]) for p in (mean, deviation)]
        self.summary = Summary(*parts, dim)

    def scores(self, some: np.ndarray, other: "Block", i: int) -> np.ndarray:
        """Exact scores of rows `some` with row i of another block."""
        if self.small and other.small:
            return (self.double[some] @ other.double[i]).astype(np.int64)
        return self.whole[some] @ other.whole[i]


def blocks(batch: pa.RecordBatch | pa.Table) -> Iterator[Block]:
    """The rows of a batch by vector length."""
    named = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
    row, label, dims = (named[c].to_numpy() for c in ("row", "label", "dim"))
    ids = named["vec_id"].fill_null(LAST).to_numpy()
    binary = [named[c].to_pylist() for c in ("vector", "mean", "deviation")]
    for dim in np.unique(dims).tolist():
        own = np.flatnonzero(dims == dim)
        yield Block(row[own], ids[own], label[own], dim, *[[p[i] for i in own.tolist()] for p in binary])


# --- search ----------------------------------------------------------------------------------------------------------

def kth(values: np.ndarray, k: int) -> float:
    """The k-th largest value, or minus infinity if there are fewer."""
    return float(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else -np.inf


class Best:
    """The k best (score, id) of one search, largest score first, then smallest id."""

    def __init__(self, k: int):
        self.k, self.score, self.id, self.row = k, *np.empty((3, 0), np.int64)

    @property
    def floor(self) -> float:
        """The score below which nothing enters any more."""
        return self.score[-1] if len(self.score) == self.k else -np.inf

    def add(self, score: np.ndarray, ids: np.ndarray, row: np.ndarray) -> None:
        score, ids, row = (np.concatenate(p) for p in ((self.score, score), (self.id, ids), (self.row, row)))
        order = np.lexsort((row, ids, -score))[:self.k]
        self.score, self.id, self.row = score[order], ids[order], row[order]


def search(rows: Block, anchors: Block, i: int, some: np.ndarray, windows: list[tuple[float, float, Best]]) -> int:
    """Put the rows `some` into the `windows` (least score, most score, best) of anchor i; returns the exact scores made.

    A row stays while some window could take it: its bounds meet the window, and its upper bound reaches both what the
    window already holds and the k-th largest lower bound of rows that are surely inside.
    """
    for level in range(len(LEVELS)):
        if not len(some):
            return 0
        low, high = rows.summary.bounds(level, some, anchors.summary, i)
        stay = np.zeros(len(some), bool)
        for least, most, best in windows:
            sure = low[(high <= most) & (low >= least)]
            floor = max(least, best.floor, kth(sure, best.k))
            stay |= (high >= floor) & (low <= most)
        some = some[stay]
    score = rows.scores(some, anchors, i)
    for least, most, best in windows:
        own = np.flatnonzero((score >= max(least, best.floor)) & (score <= most))
        if len(own):
            best.add(score[own], rows.id[some[own]], rows.row[some[own]])
    return len(some)


FOUND = "anchor long, window int, score long, id long, row long"


def searched(rows: DataFrame, anchors: list[Block], windows: dict[int, list[tuple[int, int]]] | None,
             same_label: bool, k: int) -> DataFrame:
    """The k best rows per anchor (by row) and window within every task: (anchor, window, score, id, row)."""
    held = rows.sparkSession.sparkContext.broadcast((anchors, windows))

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, windows = held.value
        best: dict[int, list[tuple[float, float, Best]]] = {}
        for block in anchors:
            for row in block.row.tolist():
                own = [(-np.inf, np.inf)] if windows is None else windows.get(row, [])
                best[row] = [(least, most, Best(k)) for least, most in own]
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                for rows in blocks(batch.slice(start, SLICE)):
                    alike = {v: rows.label == v for v in np.unique(rows.label).tolist()}
                    none = np.zeros(len(rows.row), bool)
                    for block in (b for b in anchors if b.dim == rows.dim):
                        for i, (row, own, label) in enumerate(zip(block.row.tolist(), block.id, block.label.tolist())):
                            if best[row]:
                                same = alike.get(label, none)
                                search(rows, block, i, np.flatnonzero((same if same_label else ~same) & (rows.id != own)),
                                       best[row])
        out = [(row, w, b) for row, some in best.items() for w, (_, _, b) in enumerate(some) if len(b.id)]
        size = np.array([len(b.id) for _, _, b in out], np.int64)
        both = lambda name, kind: np.concatenate([getattr(b, name) for _, _, b in out] or [np.empty(0)]).astype(kind)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.array([r for r, _, _ in out], np.int64), size)),
             pa.array(np.repeat(np.array([w for _, w, _ in out], np.int32), size)),
             pa.array(both("score", np.int64)), pa.array(both("id", np.int64)), pa.array(both("row", np.int64))],
            ["anchor", "window", "score", "id", "row"])

    found = rows.select("row", "vec_id", "label", "dim", "vector", "mean", "deviation").mapInArrow(find, FOUND)
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "id", "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine_block(rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES,
               margin: tuple[int, int] = MARGIN) -> DataFrame:
    """The answers of one block of anchors, which the driver holds for the time of two jobs."""
    held = list(blocks(anchors.toArrow()))
    best = searched(rows, held, None, True, positives)
    near = write_out(best.select("anchor", (F.col("rank") - 1).alias("window"), F.col("score").alias("positive_score"),
                                 F.col("id").alias("positive_id")), "mine-positives")
    low, high = margin
    windows: dict[int, list[tuple[int, int]]] = {}
    for r in near.select("anchor", "window", "positive_score").orderBy("anchor", "window").collect():  # of one block
        windows.setdefault(r.anchor, []).append((-(-low * r.positive_score // 100), high * r.positive_score // 100))
    far = searched(rows, held, windows, False, negatives)
    names = anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    null = lambda c: F.when(F.col(c) != F.lit(LAST), F.col(c))
    found = far.join(near, ["anchor", "window"]).join(names, "anchor")
    return found.select("anchor_id", null("positive_id").alias("positive_id"), F.col("rank").cast("int").alias("rank"),
                        null("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def mine(rows: DataFrame, is_anchor: str = "vec_id % 100 = 0", block: int = BLOCK, **options) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for all anchors against all rows.

    `rows` have vec_id, label and embedding. The loop is over blocks of anchors: the number of jobs grows with the
    anchors, the memory of the driver and the tasks does not.
    """
    table = write_out(prepared(rows), "mine-rows")
    anchors = table.filter(is_anchor)
    count = anchors.count()
    n_blocks = max(1, -(-count // block))
    if n_blocks == 1:
        return mine_block(table, anchors, **options)
    dealt = write_out(anchors.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(n_blocks)).cast("int")), "mine-anchors",
                      partition_by=["part"])
    found = None
    for part in range(n_blocks):
        own = dealt.filter(F.col("part") == part).drop("part")
        some = write_out(mine_block(table, own, **options), "mine-block")
        found = some if found is None else found.unionByName(some)
    return found
