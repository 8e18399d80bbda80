"""Exact neighbour search and kernel sums over distinct vectors, in tasks of bounded size.

Equal vectors are one *location* with a weight, so copies cost nothing. Locations are grouped into cells
around pivots; the triangle inequality tells, per query, which cells can matter. Neighbouring cells are packed
into chunks, crowded ones cut into several, and chunks into blocks of a bounded number of bytes; queries are packed
and blocked the same way. A task holds one block of queries and one of locations at a time, and a vector travels once
per block it meets, not once per cell: the number of blocks a side grows with the rows only beyond BLOCK_BYTES each.
Inside a task the cells that no query of a batch can need are skipped.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..common import as_doubles, local_table, matrix, write_out

CELL_ROWS = 4_096
MAX_CELLS = 4_096
PIECE_ROWS = 4_096
BATCH_ROWS = 8_192
MIN_BATCH_ROWS = 256
# Vectors of locations, and of queries, that meet in one task at a time.
BLOCK_BYTES = 64 << 20
QUERY_BYTES = 32 << 20
# Locations that are one block whatever their vectors' size, as cutting them would only add rounds.
ONE_BLOCK_ROWS = 8_192
# Rows of a batch compared at a time, so that a block of distances stays in the cache.
BLOCK_ROWS = 256
BLOCK_COLUMNS = 4_096
KERNEL_COLUMNS = 1_024
SEARCH_COLUMNS = 2_048
# Vectors of either side where the locations meet themselves; and how many such meetings a task slot gets at least.
BAND_BYTES = 48 << 20
MEETINGS_PER_SLOT = 4
# A kernel sum below this is taken again relative to its largest term: under it, terms that count may be lost.
LEAST_SUM = 1e-250
# Distances are compared at this many decimals; equal ones are ordered by location.
TIE_DECIMALS = 9


def distinct_vectors(df: DataFrame, row_id: str = "row_id", embedding: str = "embedding") -> DataFrame:
    """(loc, w, vec): each distinct vector once, named after its smallest row, with its number of rows."""
    return (df.select(as_doubles(embedding).alias("vec"), F.col(row_id)).groupBy("vec")
            .agg(F.min(row_id).alias("loc"), F.count("*").alias("w")))


SLACK = 1e-6


def _slack(x: np.ndarray, y: np.ndarray) -> float:
    """How far a distance by the product form may be off, with room to spare: rounding grows with the norms."""
    return SLACK * float(np.sqrt((x * x).sum(1).max(initial=0.0) + (y * y).sum(1).max(initial=0.0)))


def _by_difference(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances without cancellation, one dimension at a time."""
    out = np.zeros((len(x), len(y)))
    for k in range(x.shape[1]):
        step = x[:, k, None] - y[None, :, k]
        out += step * step
    return out


def _squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances by the product form, of vectors that are centred beforehand."""
    out = x @ y.T
    out *= -2.0
    out += (x * x).sum(1)[:, None]
    out += (y * y).sum(1)[None, :]
    return np.maximum(out, 0.0, out=out)


class Bounds:
    """What is known of cells: pivots, radii and weights, from the triangle inequality."""

    def __init__(self, pivots: np.ndarray, radius: np.ndarray, weight: np.ndarray):
        self.pivots, self.radius, self.weight = pivots, radius, weight
        self.log_w = np.log(np.where(weight > 0, weight, 1.0))

    def home(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each vector and its distance from the pivot."""
        cell, distance = np.empty(len(x), np.int32), np.empty(len(x))
        for at in _batches(len(x)):
            d2 = _squared(x[at], self.pivots)
            cell[at] = d2.argmin(1)
            # Slack keeps bounds safe against the rounding of the product form.
            distance[at] = np.sqrt(d2[np.arange(len(d2)), cell[at]]) + _slack(x[at], self.pivots)
        return cell, distance

    def within(self, x: np.ndarray, home: np.ndarray, reach: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """Which of `cells` may hold a location closer than `reach`, for few vectors whose cell is `home`."""
        if len(self.pivots) == 1:
            return np.ones((len(x), len(cells)), bool)
        pivots = self.pivots[cells]
        d2, slack = _squared(x, pivots), _slack(x, self.pivots)
        low = np.sqrt(d2) - self.radius[cells][None, :]
        # A location of another cell lies beyond the plane halfway between the two pivots.
        own, at = np.unique(home, return_inverse=True)
        gap = np.sqrt(_squared(self.pivots[own], pivots))[at]
        d2_home = _squared(x, self.pivots[own])[np.arange(len(x)), at]
        # Squared distances are off by slack^2 at most, which a small gap magnifies.
        plane = (d2 - d2_home[:, None] - 2 * slack * slack) / (2 * np.where(gap > slack, gap, np.inf))
        near = np.maximum(low, plane) <= reach[:, None] + slack
        return near & np.isfinite(self.radius[cells])[None, :]

    def floor(self, x: np.ndarray, scale: float) -> np.ndarray:
        """The least log of a kernel sum at few vectors."""
        if len(self.pivots) == 1:
            return np.full(len(x), -np.inf)
        d, slack = np.sqrt(_squared(x, self.pivots)), _slack(x, self.pivots)
        least = np.where(self.weight > 0, self.log_w - (d + self.radius + slack) ** 2 / scale, -np.inf)
        top = least.max(1, keepdims=True)
        return (top + np.log(np.exp(least - top).sum(1, keepdims=True)))[:, 0]

    def counting(self, x: np.ndarray, floor: np.ndarray, cells: np.ndarray, scale: float, tolerance: float) -> np.ndarray:
        """Which of `cells` may add more than a share of `tolerance` to the sums at few vectors."""
        if len(self.pivots) == 1:
            return np.ones((len(x), len(cells)), bool)
        d, slack = np.sqrt(_squared(x, self.pivots[cells])), _slack(x, self.pivots)
        most = self.log_w[cells] - np.maximum(d - self.radius[cells] - slack, 0) ** 2 / scale
        return (most >= floor[:, None] + np.log(tolerance / len(self.pivots))) & (self.weight[cells] > 0)


def _batches(n: int) -> list[slice]:
    return [slice(i, min(i + BLOCK_ROWS, n)) for i in range(0, n, BLOCK_ROWS)]


def _no_rows(schema: str) -> pd.DataFrame:
    return pd.DataFrame({c.split()[0]: pd.Series([], dtype=object) for c in schema.split(", ")})


PACKED = "n int, ids binary, none binary, cell binary, vec binary, number binary"


def _pack(frame: pd.DataFrame, vec: np.ndarray, number: np.ndarray, **more) -> pd.DataFrame:
    """Rows (id, none, cell) with their vectors and one more number each, by cell, as one row."""
    order = np.argsort(frame["cell"].to_numpy(), kind="stable")
    row = {"n": len(frame), "ids": frame["id"].to_numpy(np.int64)[order].tobytes(),
           "none": frame["none"].to_numpy(bool)[order].tobytes(),
           "cell": frame["cell"].to_numpy(np.int32)[order].tobytes(), "vec": vec[order].tobytes(),
           "number": np.asarray(number, np.float64)[order].tobytes()}
    return pd.DataFrame({k: [v] for k, v in {**more, **row}.items()})


class Packed:
    """Packed rows as arrays."""

    def __init__(self, frame: pd.DataFrame):
        def whole(name: str, kind: type) -> np.ndarray:
            return np.frombuffer(b"".join(frame[name]), kind)

        self.ids, self.none, self.cell = whole("ids", np.int64), whole("none", bool), whole("cell", np.int32)
        self.x, self.number = whole("vec", np.float64).reshape(len(self.ids), -1), whole("number", np.float64)

    def __len__(self) -> int:
        return len(self.ids)

    def named(self, at: np.ndarray | slice) -> pd.Series:
        """Ids as rows had them, NULL included."""
        ids = pd.Series(self.ids[at])
        return ids.astype("Int64").mask(self.none[at]) if self.none[at].any() else ids


# Rounding of the product form relative to the norms, in single and in double precision, with room to spare.
SINGLE, DOUBLE = 2e-5, 1e-12
# How far a number rounded to single precision may be off, relative to itself.
ROUNDED = 2.5e-7


class Search:
    """The k nearest rows of `y`, by rounded distance and then by id."""

    def __init__(self, y: np.ndarray, ids: np.ndarray, k: int):
        self.y, self.ids, self.k = y, ids, min(k, len(y))
        self.norm = (y * y).sum(1)
        self.most = float(self.norm.max(initial=0.0))
        # One product gives squared distances: |x|^2 + |y|^2 - 2xy.
        self.right = None
        if self.most < 1e30:
            self.right = np.empty((y.shape[1] + 2, len(y)), np.float32)
            for at in range(0, len(y), BLOCK_COLUMNS):
                part = y[at:at + BLOCK_COLUMNS]
                self.right[:-2, at:at + BLOCK_COLUMNS] = -2 * part.T
            self.right[-2], self.right[-1] = self.norm, 1.0

    def _exact(self, x: np.ndarray, r: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, ...]:
        """The best k of the pairs (r, c) of every r, by exact distance."""
        d = np.concatenate([np.sqrt(((x[r[i:i + 65_536]] - self.y[c[i:i + 65_536]]) ** 2).sum(1))
                            for i in range(0, len(r), 65_536)] or [np.empty(0)])
        order = np.lexsort((self.ids[c], np.round(d, TIE_DECIMALS), r))
        r, c, d = r[order], c[order], d[order]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        keep = place < self.k
        return r[keep], c[keep], d[keep], place[keep]

    def nearest(self, x: np.ndarray, reach: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, ...]:
        """(row of x, row of y, distance, place from 0), nothing farther than `reach` or outside `among`."""
        own, norm = (x * x).sum(1), self.norm
        size = float(own.max(initial=0.0)) + self.most
        cut = (reach + 2 * SLACK * np.sqrt(size)) ** 2
        left = np.concatenate([x, np.ones((len(x), 1)), own[:, None]], axis=1).astype(np.float32) if size < 1e30 else None
        whole = len(among) == len(self.y)
        right = None if left is None else self.right if whole else self.right[:, among]
        kinds = (np.int64, np.int64, np.float64, np.float32)
        pile, more, held, most = [np.empty(0, kind) for kind in kinds], [], 0, 4 * self.k * len(x)
        for start in range(0, len(among), SEARCH_COLUMNS):
            cols = among[start:start + SEARCH_COLUMNS]
            some = cut[np.isfinite(cut)]
            if left is not None and (not len(some) or SINGLE * size <= 0.05 * np.median(some)):
                off, d2 = SINGLE * size, left @ right[:, start:start + SEARCH_COLUMNS]
            else:
                off, d2 = DOUBLE * size, _squared(x, self.y[cols])
            if len(some) < len(cut) and len(cols) >= self.k:
                at = np.flatnonzero(~np.isfinite(cut))
                cut[at] = self._beyond(np.partition(d2[at], self.k - 1, axis=1)[:, self.k - 1].astype(np.float64) + off)
            flat = np.flatnonzero(d2 <= (cut + off).astype(d2.dtype)[:, None])
            close = d2.ravel()[flat].astype(np.float64)
            with np.errstate(over="ignore"):  # what is too large for single precision is known by its least alone
                more.append((flat // len(cols), cols[flat % len(cols)], close - off, (close + off).astype(np.float32)))
            held += len(flat)
            if held > most:
                pile, more, held = self._lowered(cut, [np.concatenate(a) for a in zip(pile, *more)]), [], 0
                if len(pile[0]) > most:  # too close together to be told apart like this
                    r, c, d, _ = self._exact(x, *pile[:2])
                    with np.errstate(over="ignore"):
                        pile = self._lowered(cut, [r, c, d * d, (d * d).astype(np.float32)])
        return self._exact(x, *self._lowered(cut, [np.concatenate(a) for a in zip(pile, *more)])[:2])

    def _lowered(self, cut: np.ndarray, pile: list[np.ndarray]) -> list[np.ndarray]:
        """The pairs (row, column, least, most squared distance) of `pile` that can be among the best k; lowers `cut` to the k-th."""
        r, c, least, most = pile
        most = np.maximum(most, np.float32(0))
        order = np.argsort((r.astype(np.uint64) << np.uint64(32)) | most.view(np.uint32))
        r, c, least, most = r[order], c[order], least[order], most[order]
        first = np.searchsorted(r, np.arange(len(cut) + 1))
        full = np.flatnonzero(np.diff(first) >= self.k)
        last = most[first[full] + self.k - 1].astype(np.float64)
        cut[full] = np.minimum(cut[full], self._beyond(last * (1 + ROUNDED)))
        keep = least <= cut[r]
        return [r[keep], c[keep], least[keep], most[keep]]

    @staticmethod
    def _beyond(squared: np.ndarray) -> np.ndarray:
        """Room for distances that are equal once rounded."""
        return (np.sqrt(np.maximum(squared, 0.0)) * (1 + 1e-12) + 2 * 10.0 ** -TIE_DECIMALS) ** 2


def _along(pivots: np.ndarray) -> list[int]:
    """The pivots in an order that keeps neighbours together: halved along the widest dimension again and again."""
    order, todo = [], [np.arange(len(pivots))]
    while todo:
        part = todo.pop()
        if len(part) <= 2:
            order += part.tolist()
            continue
        widest = np.ptp(pivots[part], axis=0).argmax()
        part = part[np.argsort(pivots[part, widest], kind="stable")]
        todo += [part[len(part) // 2:], part[:len(part) // 2]]
    return order


class Kernel:
    """Gaussian kernel values between few vectors and `y`, some columns of `y` at a time."""

    def __init__(self, y: np.ndarray, scale: float, tolerance: float):
        self.y, self.scale, self.tolerance = y, scale, tolerance
        self.norm = (y * y).sum(1)
        # One product gives the logs: 2xy - |x|^2 - |y|^2, over the scale.
        self.right = np.concatenate([y.T, np.ones((1, len(y))), self.norm[None, :]])

    def logs(self, x: np.ndarray, among: np.ndarray | slice):
        """(columns, logs of the kernel) of the columns `among`, a whole slice or numbers in rising order."""
        own = (x * x).sum(1)
        left = np.concatenate([x * (2 / self.scale), own[:, None] / -self.scale, np.full((len(x), 1), -1 / self.scale)], axis=1)
        # The product form is off by about 1e-16 of the norms; where the bandwidth feels that, take differences.
        off = SLACK * SLACK * 1e-4 * (float(own.max(initial=0.0)) + self.norm)
        numbers = range(*among.indices(len(self.y))) if isinstance(among, slice) else among
        for start in range(0, len(numbers), KERNEL_COLUMNS):
            cols = numbers[start:start + KERNEL_COLUMNS]
            cols = slice(cols.start, cols.stop) if isinstance(cols, range) else cols
            if off[cols].max() > self.tolerance * self.scale:
                yield cols, _by_difference(x, self.y[cols]) / -self.scale
            else:
                yield cols, left @ self.right[:, cols]

    def sums(self, x: np.ndarray, w: np.ndarray, among: np.ndarray | slice) -> tuple[np.ndarray, np.ndarray]:
        """(top, total) of every x: its weighted sum is total * exp(top)."""
        top, total = np.zeros(len(x)), np.zeros(len(x))
        for cols, logs in self.logs(x, among):
            total += np.exp(logs, out=logs) @ w[cols]
        small = np.flatnonzero(~(total >= LEAST_SUM))
        if len(small):
            top[small], total[small] = self._relative(x[small], np.log(w), among)
        return top, total

    def _relative(self, x: np.ndarray, log_w: np.ndarray, among: np.ndarray | slice) -> tuple[np.ndarray, np.ndarray]:
        top, total = np.full(len(x), -np.inf), np.zeros(len(x))
        for cols, logs in self.logs(x, among):
            logs += log_w[cols]
            higher = np.maximum(top, logs.max(1))
            logs -= higher[:, None]
            total = total * np.exp(top - higher) + np.exp(logs, out=logs).sum(1)
            top = higher
        return top, total


def _meet(a: Packed, b: Packed | None, needed: Callable, scale: float, tolerance: float) -> tuple[np.ndarray, ...]:
    """Kernel sums of locations of `a` over `b` and of `b` over `a`, every pair computed once; of `a` over `a` without `b`.

    `needed(p, q)` says which cells of q some row of each batch of p needs: batches of p by the cells that q has. A row
    and its own location are always met, so sums over all pairs are 1 at least.
    """
    y = a if b is None else b
    kernel, to_a, to_y = Kernel(y.x, scale, tolerance), np.zeros(len(a)), np.zeros(len(y))
    cells_a, code_a = np.unique(a.cell, return_inverse=True)
    cells_y, code_y = np.unique(y.cell, return_inverse=True)
    forth, back = needed(a, cells_y), needed(y, cells_a)
    batch_y = np.arange(len(y)) // BLOCK_ROWS
    for i, at in enumerate(_batches(len(a))):
        first = at.start if b is None else 0
        wanted = forth[i][code_y] | back[:, np.unique(code_a[at])].any(1)[batch_y]
        if b is None:
            wanted[at] = True
        among = slice(first, len(y)) if wanted[first:].all() else first + np.flatnonzero(wanted[first:])
        for cols, logs in kernel.logs(a.x[at], among):
            values = np.exp(logs, out=logs)
            to_a[at] += values @ y.number[cols]
            sums = a.number[at] @ values
            if b is None:  # rows of the batch itself have met each other as rows
                sums[(np.arange(cols.start, cols.stop) if isinstance(cols, slice) else cols) < at.stop] = 0.0
            to_y[cols] += sums
    return (to_a + to_y, None) if b is None else (to_a, to_y)


def _dealt(spark, costs: list[float]) -> list[int]:
    """A key for each piece of work, so that a shuffle by key gives its partitions equal work."""
    parts = int(spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None)
                or spark.conf.get("spark.sql.shuffle.partitions"))
    n = 16 * max(parts, len(costs))
    keys = F.col("id").cast("int")
    at = [r.at for r in spark.range(0, n, 1, 1).orderBy("id").select(F.pmod(F.hash(keys), parts).alias("at")).collect()]
    free: list[list[int]] = [[] for _ in range(parts)]
    for key, part in enumerate(at):
        free[part].append(key)
    spare = [n + i for i in range(len(costs))]
    load, dealt = [(0.0, i) for i in range(parts)], [0] * len(costs)
    for i in sorted(range(len(costs)), key=lambda i: -costs[i]):
        done, part = heapq.heappop(load)
        dealt[i] = free[part].pop() if free[part] else spare.pop()
        heapq.heappush(load, (done + costs[i], part))
    return dealt


class Cells:
    """Training locations grouped around pivots. Holds only pivots and one summary row per cell."""

    def __init__(self, train: DataFrame, seed: int = 42, cell_rows: int = CELL_ROWS,
                 piece_rows: int = PIECE_ROWS, batch_rows: int = BATCH_ROWS):
        """`cell_rows`, `piece_rows` and `batch_rows` size the work; results do not depend on them."""
        self.spark = train.sparkSession
        self.batch_rows = batch_rows
        found = write_out(distinct_vectors(train), "locations")
        self.size, self.rows = found.agg(F.count("*"), F.sum("w")).first()
        if not self.size:
            raise ValueError("no training rows")
        n_cells = min(MAX_CELLS, -(-self.size // cell_rows))
        order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("loc").cast("string")))
        pivots = found.orderBy(order, "loc").limit(n_cells).select("vec").collect()
        self.pivots = np.array([r.vec for r in pivots], dtype=np.float64)
        self.centre = self.pivots.mean(axis=0)
        self.pivots -= self.centre
        if n_cells == 1:
            self.locations = found.withColumn("cell", F.lit(0))
            self.radius, self.weight = np.array([np.inf]), np.array([self.rows])
            counts = {0: self.size}
        else:
            self.radius, self.weight = np.full(n_cells, np.inf), np.ones(n_cells)
            placed = write_out(found.withColumn("_at", self._nearest_pivot()("vec"))
                               .select("loc", "w", "vec", "_at.cell", "_at.distance"), "cells")
            summary = placed.groupBy("cell").agg(F.count("*").alias("n"), F.sum("w").alias("w"),
                                                 F.max("distance").alias("r")).collect()
            self.radius, self.weight = np.full(n_cells, -np.inf), np.zeros(n_cells)
            for s in summary:
                self.radius[s.cell], self.weight[s.cell] = s.r, s.w
            counts = {s.cell: s.n for s in summary}
            self.locations = placed.select("loc", "w", "vec", "cell")
        self.pieces = {c: -(-n // piece_rows) for c, n in counts.items()}
        self.bounds = Bounds(self.pivots, self.radius, self.weight)
        self._pack_locations(counts, piece_rows)

    # --- blocks

    def _rows_in(self, size: int) -> int:
        return max(1, size // (8 * max(1, self.pivots.shape[1])))

    def _pack_locations(self, counts: dict[int, int], piece_rows: int) -> None:
        """Chunks of at most about `piece_rows` locations of neighbouring cells; consecutive chunks are a block."""
        parallel = self.spark.sparkContext.defaultParallelism
        sides = 1 if self.size <= ONE_BLOCK_ROWS else max(1, int(np.sqrt(parallel)))
        self.block_rows = min(self._rows_in(BLOCK_BYTES), -(-self.size // sides))
        rows = min(piece_rows, self.block_rows)
        at = filled = 0
        first, cut = {}, {}
        for cell in _along(self.pivots):
            n = counts.get(cell, 0)
            if filled and filled + n > rows:
                at, filled = at + 1, 0
            first[cell], cut[cell] = at, max(1, -(-n // rows))
            at, filled = (at + cut[cell], 0) if cut[cell] > 1 else (at, filled + n)
        chunks = at + (filled > 0)
        first = {c: min(f, chunks - 1) for c, f in first.items()}
        per_block = max(1, self.block_rows // rows)
        self.n_blocks = -(-chunks // per_block)
        cells = range(len(self.pivots))
        # The first and the last block of every cell.
        self.spans = np.array([(first[c] // per_block, (first[c] + cut[c] - 1) // per_block) for c in cells])
        self.places = local_table(self.spark, [(c, first[c], cut[c]) for c in cells], "cell int, chunk int, cut int")
        centre = self.centre

        def pack(frame: pd.DataFrame) -> pd.DataFrame:
            return _pack(frame, matrix(frame["vec"]) - centre, frame["w"], chunk=int(frame["chunk"].iloc[0]))

        chunked = self._in_chunks(self.locations.withColumnRenamed("loc", "id")).select("chunk", "id", "none", "w", "vec", "cell")
        packed = chunked.groupBy("chunk").applyInPandas(pack, f"chunk int, {PACKED}")
        self.packed = write_out(packed.withColumn("block", F.expr(f"cast(chunk div {per_block} as int)")), "chunks")

    def _in_chunks(self, df: DataFrame) -> DataFrame:
        """Add the chunk of the row's cell, one by hash where the cell has several; NULL ids are marked."""
        at = F.pmod(F.xxhash64("id", "vec"), F.col("cut")).cast("int")
        return (df.join(F.broadcast(self.places), "cell").withColumn("chunk", F.col("chunk") + at).drop("cut")
                .withColumn("none", F.col("id").isNull()).withColumn("id", F.coalesce(F.col("id").cast("long"), F.lit(0))))

    def _nearest_pivot(self) -> Callable:
        shared, centre = self.spark.sparkContext.broadcast(Bounds(self.pivots, self.radius, self.weight)), self.centre

        @F.pandas_udf("cell int, distance double")
        def nearest(vec: pd.Series) -> pd.DataFrame:
            cell, distance = shared.value.home(matrix(vec) - centre)
            return pd.DataFrame({"cell": cell, "distance": distance})

        return nearest

    def _planned(self, queries: DataFrame, bound: Callable, near: Callable, meet: bool) -> DataFrame | None:
        """The (qid, vec) queries packed by home, with their bounds, the blocks they visit and their own block.

        `bound(x, locations)` gives a number per query, `near(x, home, bound, cells)` the cells that matter with it. With
        `meet`, `locations` are those of the query's home chunk.
        """
        if "cell" not in queries.columns:
            cell = F.lit(0) if len(self.pivots) == 1 else self._nearest_pivot()("vec")["cell"]
            queries = write_out(queries.withColumn("cell", cell), "queries")
        homes = self._in_chunks(queries.select(F.col("qid").alias("id"), "vec", "cell"))
        counts = sorted(map(tuple, homes.groupBy("chunk").count().collect()))
        if not counts:
            return None
        n, parallel = sum(c for _, c in counts), self.spark.sparkContext.defaultParallelism
        sides = max(1, min(-(-4 * parallel // self.n_blocks), -(-n // MIN_BATCH_ROWS)))
        rows = min(self._rows_in(QUERY_BYTES), -(-n // sides))
        batch, before, dealt = min(self.batch_rows, rows), 0, []
        for chunk, count in counts:
            parts = -(-count // batch)
            dealt += [(chunk, i, parts, int((before + i * count / parts) // rows)) for i in range(parts)]
            before += count
        table = local_table(self.spark, dealt, "chunk int, part int, parts int, qblock int")
        parts = table.select("chunk", "parts").distinct()
        part = F.pmod(F.xxhash64("id", "vec", F.lit(1)), F.col("parts")).cast("int")
        homes = homes.join(F.broadcast(parts), "chunk").withColumn("part", part).drop("parts")
        spans, centre = self.spans, self.centre
        shared = self.spark.sparkContext.broadcast(self.bounds)

        def plan(frame: pd.DataFrame, locations: pd.DataFrame | None = None) -> pd.DataFrame:
            if not len(frame):
                return _no_rows(schema)
            bounds, x, home = shared.value, matrix(frame["vec"]) - centre, frame["cell"].to_numpy()
            y = None if locations is None else Packed(locations).x
            limit, wanted = np.empty(len(x)), np.zeros(len(spans), bool)
            every = np.arange(len(spans))
            for at in _batches(len(x)):
                limit[at] = bound(bounds, x[at], y)
                wanted |= near(bounds, x[at], home[at], limit[at], every).any(0)
            blocks = sorted({b for first, last in np.unique(spans[wanted], axis=0).tolist() for b in range(first, last + 1)})
            return _pack(frame, x, limit, chunk=int(frame["chunk"].iloc[0]), part=int(frame["part"].iloc[0]),
                         blocks=np.array(blocks, np.int32))

        schema = f"chunk int, part int, blocks array<int>, {PACKED}"
        grouped = homes.select("chunk", "part", "id", "none", "vec", "cell").groupBy("chunk", "part")
        if meet:
            right = self.packed.join(F.broadcast(table.select("chunk", "part")), "chunk")
            packed = grouped.cogroup(right.groupBy("chunk", "part")).applyInPandas(plan, schema)
        else:
            packed = grouped.applyInPandas(lambda frame: plan(frame), schema)
        return write_out(packed.join(F.broadcast(table.drop("parts")), ["chunk", "part"]), "visits")

    def _tiles(self, planned: DataFrame, kernel: Callable, schema: str) -> DataFrame:
        """Meet every block of queries with the blocks of locations it visits; `kernel(queries, locations)` per pair."""
        columns = [c.split()[0] for c in PACKED.split(", ")]
        met = planned.select("qblock", F.explode("blocks").alias("block"), "n")
        costs = sorted(map(tuple, met.groupBy("qblock", "block").agg(F.sum("n")).collect()))
        keys = _dealt(self.spark, [c for *_, c in costs])
        rows = [(q, b, k) for (q, b, _), k in zip(costs, keys)]
        tiles, other = (local_table(self.spark, rows, f"qblock int, block int, {c} int") for c in ("tile", "visited"))
        visits = planned.withColumn("block", F.explode("blocks")).join(F.broadcast(tiles), ["qblock", "block"])
        visits = visits.select("tile", "chunk", "part", *columns)
        right = self.packed.join(F.broadcast(other), "block").select("visited", "chunk", *columns)

        def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(left) or not len(right):
                return _no_rows(schema)
            return kernel(Packed(left.sort_values(["chunk", "part"])), Packed(right.sort_values("chunk")))

        return visits.groupBy("tile").cogroup(right.groupBy("visited")).applyInPandas(meet, schema)

    def _empty(self, schema: str) -> DataFrame:
        return self.spark.createDataFrame([], schema)

    # --- answers

    def nearest(self, queries: DataFrame, m: int) -> DataFrame:
        """(qid, nbr, w, d, place): the m nearest distinct locations of each (qid, vec) query.

        Queries with a `cell` column are taken to lie in that cell.
        """
        schema = "qid long, nbr long, w long, d double, place int"

        # The locations of a query's home chunk bound the distance of the m-th neighbour ...
        def reach(bounds: Bounds, x: np.ndarray, y: np.ndarray | None) -> np.ndarray:
            if y is None or len(y) < m:
                return np.full(len(x), np.inf)
            return np.sqrt(np.partition(_squared(x, y), m - 1, axis=1)[:, m - 1]) + _slack(x, y)

        # ... only blocks and cells that come closer than that are searched, and nothing farther is kept.
        planned = self._planned(queries, reach, Bounds.within, meet=self.n_blocks > 1 or len(self.pieces) > 1)
        if planned is None:
            return self._empty(schema)
        shared = self.spark.sparkContext.broadcast(self.bounds)

        def best(q: Packed, t: Packed) -> pd.DataFrame:
            cells, code = np.unique(t.cell, return_inverse=True)
            search, out = Search(t.x, t.ids, m), []
            for at in _batches(len(q)):
                wanted = shared.value.within(q.x[at], q.cell[at], q.number[at], cells).any(0)
                r, c, d, place = search.nearest(q.x[at], q.number[at], np.flatnonzero(wanted[code]))
                out.append(pd.DataFrame({"qid": q.named(at.start + r), "nbr": t.named(c), "w": t.number[c].astype(np.int64),
                                         "d": d, "place": place + 1}))
            return pd.concat(out)

        found = self._tiles(planned, best, schema)
        if self.n_blocks == 1:
            return found
        order = Window.partitionBy("qid").orderBy(F.round("d", TIE_DECIMALS), "nbr")
        return found.drop("place").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= m)

    def _cells_within(self) -> Callable:
        shared, centre = self.spark.sparkContext.broadcast(self.bounds), self.centre

        @F.pandas_udf("array<int>")
        def within(vec: pd.Series, reach: pd.Series) -> pd.Series:
            bounds, x, reach, found = shared.value, matrix(vec) - centre, reach.to_numpy(), []
            for at in _batches(len(x)):
                near = bounds.within(x[at], bounds.home(x[at])[0], reach[at], np.arange(len(bounds.pivots)))
                found += [np.flatnonzero(row).astype(np.int32) for row in near]
            return pd.Series(found)

        return within

    def log_kernel_sum(self, queries: DataFrame, bandwidth: float, tolerance: float = 1e-12) -> DataFrame:
        """(qid, log_sum): log of the weighted Gaussian kernel sum over all training rows.

        A cell is left out only if the most it could add is under `tolerance` of the least the rest adds.
        """
        scale, sums = 2.0 * bandwidth * bandwidth, "qid long, top double, total double"

        def floor(bounds: Bounds, x: np.ndarray, y: None) -> np.ndarray:
            return bounds.floor(x, scale)

        def near(bounds: Bounds, x: np.ndarray, home: np.ndarray, floor: np.ndarray, cells: np.ndarray) -> np.ndarray:
            return bounds.counting(x, floor, cells, scale, tolerance)

        planned = self._planned(queries, floor, near, meet=False)
        if planned is None:
            return self._empty("qid long, log_sum double")
        shared = self.spark.sparkContext.broadcast(self.bounds)

        def partial(q: Packed, t: Packed) -> pd.DataFrame:
            cells, code = np.unique(t.cell, return_inverse=True)
            kernel, out = Kernel(t.x, scale, tolerance), []
            for at in _batches(len(q)):
                wanted = near(shared.value, q.x[at], q.cell[at], q.number[at], cells).any(0)[code]
                among = slice(0, len(t)) if wanted.all() else np.flatnonzero(wanted)
                top, total = kernel.sums(q.x[at], t.number, among)
                if wanted.any():
                    out.append(pd.DataFrame({"qid": q.named(at), "top": top, "total": total}))
            return pd.concat(out) if out else _no_rows(sums)

        parts = self._tiles(planned, partial, sums)
        if self.n_blocks == 1:
            return parts.select("qid", (F.col("top") + F.log("total")).alias("log_sum"))
        highest = F.max("top").over(Window.partitionBy("qid"))
        return (parts.withColumn("highest", highest).groupBy("qid")
                .agg((F.max("highest") + F.log(F.sum(F.col("total") * F.exp(F.col("top") - F.col("highest")))))
                     .alias("log_sum")))

    def own_log_kernel_sums(self, bandwidth: float, tolerance: float = 1e-12) -> DataFrame:
        """(loc, log_sum): as `log_kernel_sum` at the locations themselves, for half the work.

        Locations are cut into bands of chunks; two bands meet once and give each other their sums. Cells are left out
        as there: where neither side needs the other.
        """
        scale, per_slot = 2.0 * bandwidth * bandwidth, MEETINGS_PER_SLOT * self.spark.sparkContext.defaultParallelism
        n_bands = 1 if self.size <= ONE_BLOCK_ROWS else int(np.ceil(np.sqrt(2 * per_slot)))
        sizes = dict(map(tuple, self.packed.select("chunk", "n").collect()))
        rows, band, before = min(self._rows_in(BAND_BYTES), -(-self.size // n_bands)), {}, 0
        for chunk in sorted(sizes):
            band[chunk] = before // rows
            before += sizes[chunk]
        table = local_table(self.spark, sorted(band.items()), "chunk int, band int")
        packed = self.packed.drop("block").join(F.broadcast(table), "chunk")
        shared = self.spark.sparkContext.broadcast(self.bounds)
        floors, pairs = self._met_bands(packed, scale, tolerance)
        members: dict[int, int] = {}
        for chunk, at in band.items():
            members[at] = members.get(at, 0) + sizes[chunk]
        keys = _dealt(self.spark, [members[i] * members[j] * (0.5 if i == j else 1.0) for i, j in pairs])
        sides = [(i, k, False) for (i, _), k in zip(pairs, keys)] + [(j, k, True) for (i, j), k in zip(pairs, keys) if i < j]
        tiles = F.broadcast(local_table(self.spark, sides, "band int, tile int, second boolean"))

        def needed(p: Packed, cells: np.ndarray) -> np.ndarray:
            bounds = shared.value
            return np.array([bounds.counting(p.x[at], floors[p.cell[at]], cells, scale, tolerance).any(0)
                             for at in _batches(len(p))])

        def split(frame: pd.DataFrame, tile: int, sums: np.ndarray) -> pd.DataFrame:
            parts = np.split(sums, np.cumsum(frame["n"].to_numpy())[:-1])
            return pd.DataFrame({"chunk": frame["chunk"].to_numpy(), "tile": tile, "sums": [p.tobytes() for p in parts]})

        def meet(frame: pd.DataFrame) -> pd.DataFrame:
            tile, second = int(frame["tile"].iloc[0]), frame["second"].to_numpy(bool)
            left, right = (frame[of].sort_values("chunk") for of in (~second, second))
            a, b = _meet(Packed(left), Packed(right) if len(right) else None, needed, scale, tolerance)
            return pd.concat([split(left, tile, a)] + ([] if b is None else [split(right, tile, b)]))

        def total(places: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
            sums = sum(np.frombuffer(s, np.float64) for s in parts.sort_values("tile")["sums"])
            ids, none = (np.frombuffer(places[c].iloc[0], kind) for c, kind in (("ids", np.int64), ("none", bool)))
            ids = pd.Series(ids).astype("Int64").mask(none) if none.any() else pd.Series(ids)
            return pd.DataFrame({"loc": ids, "log_sum": np.log(sums)})

        met = packed.join(tiles, "band").groupBy("tile").applyInPandas(meet, "chunk int, tile int, sums binary")
        parts = write_out(met, "meetings").groupBy("chunk")
        return (self.packed.select("chunk", "ids", "none").groupBy("chunk").cogroup(parts)
                .applyInPandas(total, "loc long, log_sum double"))

    def _met_bands(self, packed: DataFrame, scale: float, tolerance: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """The least log of a sum at any location of each cell, and the pairs (i <= j) of bands that must meet."""
        n_cells, shared = len(self.pivots), self.spark.sparkContext.broadcast(self.bounds)
        homes = packed.select("band", "n", "ids", "none", "cell", "vec", "number")
        if n_cells == 1:
            bands = sorted(r.band for r in packed.select("band").distinct().collect())
            return np.full(1, -np.inf), [(i, j) for i in bands for j in bands if i <= j]

        def look(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for k in range(len(frame)):
                    here = Packed(frame.iloc[k:k + 1])
                    least, wanted = np.full(n_cells, np.inf), np.zeros(n_cells, bool)
                    for at in _batches(len(here)):
                        # A location's own weight is part of its sum.
                        floor = np.maximum(shared.value.floor(here.x[at], scale), np.log(here.number[at]))
                        np.minimum.at(least, here.cell[at], floor)
                        wanted |= shared.value.counting(here.x[at], floor, np.arange(n_cells), scale, tolerance).any(0)
                    cells = np.unique(here.cell)
                    yield pd.DataFrame({"band": [int(frame["band"].iloc[k])], "cells": [cells], "floors": [least[cells]],
                                        "wanted": [np.flatnonzero(wanted).astype(np.int32)]})

        seen = write_out(homes.mapInPandas(look, "band int, cells array<int>, floors array<double>, wanted array<int>"), "floors")
        of = seen.select("band", F.explode(F.arrays_zip("cells", "floors")).alias("c")).select("band", "c.cells", "c.floors")
        least = of.groupBy("cells").agg(F.min("floors").alias("floor")).collect()
        floors = np.full(n_cells, -np.inf)
        for r in least:
            floors[r.cells] = r.floor
        held = of.select(F.col("band").alias("other"), F.col("cells").alias("cell")).distinct()
        asked = seen.select("band", F.explode("wanted").alias("cell")).distinct().join(held, "cell")
        pairs = asked.select(F.least("band", "other").alias("i"), F.greatest("band", "other").alias("j")).distinct()
        own = {(r.band, r.band) for r in seen.select("band").distinct().collect()}
        return floors, sorted({(r.i, r.j) for r in pairs.collect()} | own)
