from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ...common import matrix
from .base import Detector, moments
from .gradient import SHARD_ROWS, GradientFit, Net
from .stored import StoredModel, hidden_then_linear, scaling, shifted


def row_noise(row_id: np.ndarray, step: int, width: int, seed: int) -> np.ndarray:
    """Standard normal noise that depends only on row, step and seed, so a rerun task draws the same."""
    def mix(v: np.ndarray) -> np.ndarray:
        v = (v ^ (v >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        v = (v ^ (v >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return v ^ (v >> np.uint64(31))

    with np.errstate(over="ignore"):
        rows = mix(row_id.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        draws = np.arange(2 * width, dtype=np.uint64) + np.uint64(step * 2 * width + (seed << 32))
        bits = mix(rows[:, None] ^ mix(draws)[None, :])
    u = ((bits >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0 ** 53
    return np.sqrt(-2.0 * np.log(u[:, :width])) * np.cos(2.0 * np.pi * u[:, width:])


class _Trained(Detector):
    """Shared steps: fit by gradient passes, score by one Arrow-batched projection."""

    def __init__(self, epochs: int = 100, rounds: int = 5, batch_rows: int = 64, rate: float = 0.005, seed: int = 42,
                 shard_rows: int = SHARD_ROWS):
        """`rounds` is how often the shards' weights are averaged, each time one Spark job."""
        self.epochs, self.rate, self.seed = epochs, rate, seed
        self.loop_settings = {"rounds": rounds, "batch_rows": batch_rows, "shard_rows": shard_rows}

    def _start(self, train: DataFrame, decay: float = 0.0) -> int:
        self.loop = GradientFit(self.epochs, rate=self.rate, decay=decay, seed=self.seed, **self.loop_settings)
        self.loop.prepare(train, ["y_semi"] if self.uses_labels else [])
        return self.loop.table.select(F.size("embedding")).first()[0]

    def _scored(self, rows: DataFrame, scorer: Callable, state) -> DataFrame:
        shared = rows.sparkSession.sparkContext.broadcast(state)

        @F.pandas_udf("double")
        def value(embedding: pd.Series) -> pd.Series:
            return pd.Series(scorer(shared.value, matrix(embedding)))

        return rows.withColumn("score", value("embedding"))


def _scaled(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return (x - mean) / scale


class AutoEncoder(_Trained):
    """Distance between a standardised vector and its reconstruction."""

    def __init__(self, hidden: Sequence[int] = (64, 32), **loop):
        super().__init__(**loop)
        self.hidden = list(hidden)

    def fit(self, train: DataFrame) -> "AutoEncoder":
        dim = self._start(train)
        m = moments(self.loop.table)
        net = Net([dim, *self.hidden, *self.hidden[-2::-1], dim])

        def loss(theta, batch, step):
            x = _scaled(batch.x, m.mean, m.scale)
            values = net.forward(theta, x)
            diff = values[-1] - x
            return (diff * diff).sum(), net.backward(theta, values, 2.0 * diff)[0]

        self.net, self.moments = net, m
        self.theta = self.loop.minimise(loss, net.initial(np.random.default_rng(self.seed)))
        return self

    def score(self, rows: DataFrame) -> DataFrame:
        net = self.net

        def error(state, x):
            theta, mean, scale = state
            x = _scaled(x, mean, scale)
            return np.linalg.norm(net.forward(theta, x)[-1] - x, axis=1)

        return self._scored(rows, error, (self.theta, self.moments.mean, self.moments.scale))

    def stored(self) -> StoredModel:
        rows = scaling(self.moments.mean, self.moments.scale) + shifted(self.net.as_rows(self.theta), 1)
        return StoredModel(rows, ["linear", *hidden_then_linear(len(self.net.shapes))], "norm", against=0)


class VariationalAutoEncoder(_Trained):
    """Reconstruction plus KL divergence in training (Kingma and Welling 2014); scored at the mean code."""

    def __init__(self, hidden: Sequence[int] = (64, 32), latent: int = 2, **loop):
        super().__init__(**loop)
        self.hidden, self.latent = list(hidden), latent

    def fit(self, train: DataFrame) -> "VariationalAutoEncoder":
        dim = self._start(train)
        m = moments(self.loop.table)
        code, seed = self.latent, self.seed
        encoder = Net([dim, *self.hidden, 2 * code])
        decoder = Net([code, *self.hidden[::-1], dim])
        cut = encoder.width

        def loss(theta, batch, step):
            x = _scaled(batch.x, m.mean, m.scale)
            noise = row_noise(batch.row_id, step, code, seed)
            return vae_loss(encoder, decoder, theta, x, noise)

        rng = np.random.default_rng(seed)
        start = np.concatenate([encoder.initial(rng) * 0.5, decoder.initial(rng)])
        self.encoder, self.decoder, self.cut, self.moments = encoder, decoder, cut, m
        self.theta = self.loop.minimise(loss, start)
        return self

    def score(self, rows: DataFrame) -> DataFrame:
        encoder, decoder, cut, code = self.encoder, self.decoder, self.cut, self.latent

        def error(state, x):
            theta, mean, scale = state
            x = _scaled(x, mean, scale)
            mean_code = encoder.forward(theta[:cut], x)[-1][:, :code]
            return np.linalg.norm(decoder.forward(theta[cut:], mean_code)[-1] - x, axis=1)

        return self._scored(rows, error, (self.theta, self.moments.mean, self.moments.scale))

    def stored(self) -> StoredModel:
        n_encode, n_decode = len(self.encoder.shapes), len(self.decoder.shapes)
        encoder = [r for r in self.encoder.as_rows(self.theta[:self.cut])
                   if r[0] < n_encode - 1 or r[2] < self.latent]  # the code's mean, without its spread
        rows = (scaling(self.moments.mean, self.moments.scale) + shifted(encoder, 1)
                + shifted(self.decoder.as_rows(self.theta[self.cut:]), 1 + n_encode))
        steps = ["linear", *hidden_then_linear(n_encode), *hidden_then_linear(n_decode)]
        return StoredModel(rows, steps, "norm", against=0)


def vae_loss(encoder: Net, decoder: Net, theta: np.ndarray, x: np.ndarray, noise: np.ndarray):
    cut, code = encoder.width, noise.shape[1]
    encoded = encoder.forward(theta[:cut], x)
    mean, log_var = encoded[-1][:, :code], encoded[-1][:, code:]
    inside = np.abs(log_var) < 10.0  # beyond that the exponential is held
    log_var = np.clip(log_var, -10.0, 10.0)
    spread = np.exp(0.5 * log_var)
    decoded = decoder.forward(theta[cut:], mean + spread * noise)
    diff = decoded[-1] - x
    value = (diff * diff).sum() - 0.5 * (1.0 + log_var - mean * mean - spread * spread).sum()
    by_decoder, by_code = decoder.backward(theta[cut:], decoded, 2.0 * diff)
    by_log_var = (0.5 * by_code * noise * spread + 0.5 * (spread * spread - 1.0)) * inside
    by_encoder, _ = encoder.backward(theta[:cut], encoded, np.hstack([by_code + mean, by_log_var]))
    return value, np.concatenate([by_encoder, by_decoder])


class DeepSVDD(_Trained):
    """Squared distance to a centre under a bias-free network (Ruff et al. 2018)."""

    def __init__(self, rep_dim: int = 128, hidden: Sequence[int] = (100, 50), rate: float = 0.001, **loop):
        super().__init__(rate=rate, **loop)  # a low rate: trained for long, the net maps outliers to the centre as well
        self.rep_dim, self.hidden = rep_dim, list(hidden)

    def fit(self, train: DataFrame) -> "DeepSVDD":
        dim = self._start(train, decay=1e-6)
        net = Net([dim, *self.hidden, self.rep_dim], bias=False)
        start = net.initial(np.random.default_rng(self.seed))
        total = self.loop.sum(lambda theta, batch: np.concatenate(
            [[len(batch)], net.forward(theta, batch.x)[-1].sum(0)]), start)
        centre = total[1:] / total[0]
        # Coordinates near zero could be met by zero weights.
        near_zero = np.abs(centre) < 0.1
        centre = np.where(near_zero, np.where(centre < 0, -0.1, 0.1), centre)
        labelled = self.uses_labels

        def loss(theta, batch, step):
            values = net.forward(theta, batch.x)
            known = batch.known if labelled else np.zeros(len(batch), dtype=bool)
            value, out = centre_loss(values[-1] - centre, known)
            return value, net.backward(theta, values, out)[0]

        self.net, self.centre = net, centre
        self.theta = self.loop.minimise(loss, start)
        return self

    def score(self, rows: DataFrame) -> DataFrame:
        net = self.net
        return self._scored(rows, lambda state, x: ((net.forward(state[0], x)[-1] - state[1]) ** 2).sum(1),
                            (self.theta, self.centre))

    def stored(self) -> StoredModel:
        last = len(self.net.shapes) - 1
        centre = [(last, -1, j, -float(c)) for j, c in enumerate(self.centre)]
        return StoredModel(self.net.as_rows(self.theta) + centre, hidden_then_linear(last + 1), "square")


def centre_loss(away: np.ndarray, known: np.ndarray, eta: float = 1.0, floor: float = 1e-6):
    """Squared distance for unlabelled rows, its inverse for known anomalies; and the gradient."""
    distance = (away * away).sum(1)
    value = np.where(known, eta / (distance + floor), distance).sum()
    slope = np.where(known, -eta / (distance + floor) ** 2, 1.0)
    return value, 2.0 * away * slope[:, None]


class DeepSAD(DeepSVDD):
    """Deep SVDD that pushes known anomalies away from the centre (Ruff et al. 2020)."""

    uses_labels = True


class DevNet(_Trained):
    """Deviation network (Pang et al. 2019): scores of known anomalies lie `margin` reference deviations up."""

    uses_labels = True

    def __init__(self, hidden: Sequence[int] = (100, 50), margin: float = 5.0, draws: int = 5000, **loop):
        super().__init__(**loop)
        self.hidden, self.margin, self.draws = list(hidden), margin, draws

    def fit(self, train: DataFrame) -> "DevNet":
        dim = self._start(train)
        rng = np.random.default_rng(self.seed)
        reference = rng.normal(size=self.draws)
        middle, spread, margin = reference.mean(), reference.std(), self.margin
        n, known = self.loop.table.agg(F.count("*"), F.sum("y_semi")).first()
        # Both sides weigh the same, as in batches drawn half and half.
        weight = (n - known) / known if known else 0.0
        net = Net([dim, *self.hidden, 1])

        def loss(theta, batch, step):
            values = net.forward(theta, batch.x)
            value, out = deviation_loss(values[-1][:, 0], batch.known, middle, spread,
                                        margin, weight)
            return value, net.backward(theta, values, out[:, None])[0]

        self.net = net
        self.theta = self.loop.minimise(loss, net.initial(rng))
        return self

    def score(self, rows: DataFrame) -> DataFrame:
        net = self.net
        return self._scored(rows, lambda theta, x: net.forward(theta, x)[-1][:, 0], self.theta)

    def stored(self) -> StoredModel:
        return StoredModel(self.net.as_rows(self.theta), hidden_then_linear(len(self.net.shapes)))


def deviation_loss(score, known, middle, spread, margin, weight):
    deviation = (score - middle) / spread
    short = margin - deviation
    value = np.where(known, weight * np.maximum(short, 0.0), np.abs(deviation)).sum()
    slope = np.where(known, -weight * (short > 0), np.sign(deviation)) / spread
    return value, slope
