"""Gradient descent in few Spark jobs: tasks take many steps each, their weights are averaged on executors."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ...common import matrix, write_bucketed

# Per-task sums that may reach the driver at once; more are first added up on executors.
MAX_PARTIALS = 64
SHARD_ROWS = 8_192  # rows that one task steps through
MAX_BUCKETS = 4_096  # files of the training table; a file may hold several shards


@dataclass
class Batch:
    """Rows of a mini-batch; `known` marks the known anomalies where the detector uses labels."""

    x: np.ndarray
    row_id: np.ndarray
    known: np.ndarray | None

    @classmethod
    def of(cls, frame: pd.DataFrame) -> "Batch":
        known = frame["y_semi"].to_numpy() == 1 if "y_semi" in frame else None
        return cls(matrix(frame["embedding"]), frame["row_id"].to_numpy(), known)

    def __len__(self) -> int:
        return len(self.x)

    def some(self, at: np.ndarray) -> "Batch":
        return Batch(self.x[at], self.row_id[at], None if self.known is None else self.known[at])


def add_up(parts: DataFrame, column: str, partials: int) -> np.ndarray | None:
    """Sum of the vectors in `column`; None without rows. More than MAX_PARTIALS are added up on executors first."""
    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            if len(batch):
                part = matrix(batch[column]).sum(0)
                total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({column: [total]})

    parts = parts.select(column)
    if partials > MAX_PARTIALS:
        parts = parts.repartition(MAX_PARTIALS).mapInPandas(merge, f"{column} array<double>")
    rows = parts.collect()
    return np.sum([r[0] for r in rows], axis=0) if rows else None


def sum_over_rows(table: DataFrame, per_batch: Callable, state, partials: int) -> np.ndarray | None:
    """Sum of `per_batch(state, batch)` vectors over all Arrow batches of the table; None without rows."""
    shared = table.sparkSession.sparkContext.broadcast(state)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            if len(batch):
                part = per_batch(shared.value, Batch.of(batch))
                total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"total": [total]})

    total = add_up(table.mapInPandas(add, "total array<double>"), "total", partials)
    shared.unpersist()
    return total


class Adam:
    """Weights with the running moments of their gradients, as one vector that can be averaged."""

    def __init__(self, theta: np.ndarray, rate: float, decay: float):
        self.theta, self.rate, self.decay = theta, rate, decay
        self.first, self.second, self.steps = np.zeros_like(theta), np.zeros_like(theta), 0.0

    def pack(self) -> np.ndarray:
        return np.concatenate([self.theta, self.first, self.second, [self.steps]])

    def unpack(self, state: np.ndarray) -> "Adam":
        self.theta, self.first, self.second = np.split(state[:-1], 3)
        self.steps = float(state[-1])
        return self

    def step(self, gradient: np.ndarray) -> None:
        gradient = gradient + self.decay * self.theta
        self.steps += 1
        self.first = 0.9 * self.first + 0.1 * gradient
        self.second = 0.999 * self.second + 0.001 * gradient * gradient
        hat = np.sqrt(self.second / (1 - 0.999 ** self.steps)) + 1e-8
        self.theta = self.theta - self.rate * (self.first / (1 - 0.9 ** self.steps)) / hat


class GradientFit:
    """Local steps and averaging: `rounds` Spark jobs, whatever the number of epochs and steps.

    The training rows are written once, in shards of about SHARD_ROWS rows by a hash of the row. In a round a task runs
    its share of the epochs over a shard, one Adam step per mini-batch in a seeded order; the shards' weights are then
    averaged by their rows. Shards and orders follow from the rows and the seed alone, not from how tasks are dealt, so a
    fit is the same on every cluster. Each row takes part in every epoch.
    """

    def __init__(self, epochs: int = 100, rounds: int = 5, batch_rows: int = 64, rate: float = 0.005, decay: float = 0.0,
                 seed: int = 42, shard_rows: int = SHARD_ROWS):
        self.epochs, self.rounds, self.batch_rows = epochs, rounds, batch_rows
        self.rate, self.decay, self.seed, self.shard_rows = rate, decay, seed, shard_rows
        self.history: list[float] = []
        self.jobs = 0

    def prepare(self, train: DataFrame, columns: Sequence[str] = ()) -> "GradientFit":
        rows = train.select("row_id", "embedding", *columns)
        n = rows.count()
        if not n:
            raise ValueError("no training rows")
        self.shards = -(-n // self.shard_rows)
        place = F.pmod(F.xxhash64("row_id", "embedding", F.lit(self.seed)), F.lit(self.shards)).cast("int")
        self.buckets = min(self.shards, MAX_BUCKETS)
        self.table = write_bucketed(rows.withColumn("shard", place), "training", "shard", self.buckets)
        return self

    def sum(self, per_batch: Callable, state) -> np.ndarray:
        return sum_over_rows(self.table, per_batch, state, self.buckets)

    def minimise(self, loss: Callable, theta: np.ndarray) -> np.ndarray:
        """`loss(theta, batch, step)` returns the summed loss and its gradient for one mini-batch."""
        state, done = Adam(theta, self.rate, self.decay).pack(), 0
        for epochs in np.array_split(np.arange(self.epochs), min(self.rounds, self.epochs)):
            total = self._round(loss, state, done, len(epochs))
            done += len(epochs)
            state = total[1 + len(epochs):] / total[0]
            self.history += (total[1:1 + len(epochs)] / total[0]).tolist()
        return np.split(state[:-1], 3)[0]

    def _round(self, loss: Callable, state: np.ndarray, done: int, epochs: int) -> np.ndarray:
        """Rows, each epoch's summed loss and the state times the rows, summed over all shards."""
        shared = self.table.sparkSession.sparkContext.broadcast(state)
        rate, decay, seed, batch_rows, whole = self.rate, self.decay, self.seed, self.batch_rows, self.epochs

        def train(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values("row_id", kind="stable")
            rows, adam = Batch.of(frame), Adam(np.empty(0), rate, decay).unpack(shared.value)
            losses = np.zeros(epochs)
            for e in range(epochs):
                adam.rate = rate * (1 - (done + e) / whole)  # falls to nothing, so that the noise of mini-batches dies out
                order = np.random.default_rng([seed, int(frame["shard"].iloc[0]), done + e]).permutation(len(rows))
                for at in np.array_split(order, -(-len(order) // batch_rows)):
                    value, gradient = loss(adam.theta, rows.some(at), int(adam.steps))
                    adam.step(gradient / len(at))
                    losses[e] += value
            return pd.DataFrame({"total": [np.concatenate([[len(rows)], losses, len(rows) * adam.pack()])]})

        trained = self.table.groupBy("shard").applyInPandas(train, "total array<double>")
        self.jobs += 1
        total = add_up(trained, "total", self.shards)
        shared.unpersist()
        return total


class Net:
    """A dense ReLU network whose weights live in one flat vector."""

    def __init__(self, sizes: Sequence[int], bias: bool = True):
        self.shapes = list(zip(sizes[:-1], sizes[1:]))
        self.bias = bias
        self.width = sum(i * o + (o if bias else 0) for i, o in self.shapes)

    def initial(self, rng: np.random.Generator) -> np.ndarray:
        parts = []
        for i, o in self.shapes:
            parts.append(rng.normal(0.0, np.sqrt(2.0 / i), i * o))
            if self.bias:
                parts.append(np.zeros(o))
        return np.concatenate(parts)

    def _layers(self, theta: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray | float]]:
        at = 0
        for i, o in self.shapes:
            weights = theta[at:at + i * o].reshape(i, o)
            at += i * o
            shift: np.ndarray | float = 0.0
            if self.bias:
                shift = theta[at:at + o]
                at += o
            yield weights, shift

    def as_rows(self, theta: np.ndarray) -> list[tuple[int, int, int, float]]:
        """The weights as (layer, i, j, w): w leads from value i of a layer's input to value j of its output.

        The shift of output j stands under i = -1.
        """
        rows = []
        for layer, (weights, shift) in enumerate(self._layers(theta)):
            rows += [(layer, i, j, float(weights[i, j])) for i in range(weights.shape[0]) for j in range(weights.shape[1])]
            if self.bias:
                rows += [(layer, -1, j, float(v)) for j, v in enumerate(shift)]
        return rows

    def forward(self, theta: np.ndarray, x: np.ndarray) -> list[np.ndarray]:
        """Input and output of every layer; the last entry is the network's output."""
        values = [x]
        for weights, shift in self._layers(theta):
            x = values[-1] if len(values) == 1 else np.maximum(values[-1], 0.0)
            values.append(x @ weights + shift)
        return values

    def backward(self, theta: np.ndarray, values: list[np.ndarray], out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients by weight (flat) and by input, given the gradient by output."""
        parts: list[np.ndarray] = []
        layers = list(self._layers(theta))
        for depth in range(len(layers) - 1, -1, -1):
            x = values[depth] if depth == 0 else np.maximum(values[depth], 0.0)
            if self.bias:
                parts.insert(0, out.sum(0))
            parts.insert(0, (x.T @ out).ravel())
            out = out @ layers[depth][0].T
            if depth:
                out = out * (values[depth] > 0)
        return np.concatenate(parts), out
