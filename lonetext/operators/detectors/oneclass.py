from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .base import moments
from .deep import _Trained
from .stored import StoredModel


def fourier_features(x: np.ndarray, directions: np.ndarray, phases: np.ndarray) -> np.ndarray:
    return np.sqrt(2.0 / len(phases)) * np.cos(x @ directions + phases)


def one_class_loss(theta: np.ndarray, phi: np.ndarray, nu: float):
    """Summed nu-one-class objective: |w|^2 / 2 - rho + max(0, rho - w.phi) / nu; and its gradient."""
    w, rho = theta[:-1], theta[-1]
    short = rho - phi @ w
    out = short > 0
    n = len(phi)
    value = n * (0.5 * (w @ w) - rho) + short[out].sum() / nu
    return value, np.concatenate([n * w - phi[out].sum(0) / nu, [out.sum() / nu - n]])


class OCSVM(_Trained):
    """One-class SVM with an RBF kernel, solved in the primal over random Fourier features (Rahimi and Recht 2007).

    `gamma` defaults to 1 / (dim * variance of all values). `orientation='inlier'` flips the score.
    """

    def __init__(self, nu: float = 0.05, gamma: float | None = None, n_features: int = 256,
                 orientation: str = "outlier", **loop):
        super().__init__(**loop)
        if orientation not in ("outlier", "inlier"):
            raise ValueError(f"unknown orientation: {orientation}")
        self.nu, self.gamma, self.n_features, self.orientation = nu, gamma, n_features, orientation

    def fit(self, train: DataFrame) -> "OCSVM":
        dim = self._start(train)
        gamma, nu = self.gamma, self.nu
        if gamma is None:
            m = moments(self.loop.table)
            variance = (m.variance + m.mean ** 2).mean() - m.mean.mean() ** 2
            gamma = 1.0 / (dim * variance) if variance > 0 else 1.0
        rng = np.random.default_rng(self.seed)
        directions = rng.normal(0.0, np.sqrt(2.0 * gamma), (dim, self.n_features))
        phases = rng.uniform(0.0, 2.0 * np.pi, self.n_features)
        total = self.loop.sum(lambda s, batch: np.concatenate(
            [[len(batch)], fourier_features(batch.x, *s).sum(0)]), (directions, phases))
        mean = total[1:] / total[0]

        def loss(theta, batch, step):
            return one_class_loss(theta, fourier_features(batch.x, directions, phases), nu)

        self.directions, self.phases = directions, phases
        self.theta = self.loop.minimise(loss, np.concatenate([mean, [0.5 * (mean @ mean)]]))
        return self

    def score(self, rows: DataFrame) -> DataFrame:
        sign = 1.0 if self.orientation == "outlier" else -1.0

        def value(state, x):
            theta, directions, phases = state
            return sign * (theta[-1] - fourier_features(x, directions, phases) @ theta[:-1])

        return self._scored(rows, value, (self.theta, self.directions, self.phases))

    def stored(self) -> StoredModel:
        sign = 1.0 if self.orientation == "outlier" else -1.0
        size = np.sqrt(2.0 / self.n_features)
        rows = [(0, i, j, float(w)) for (i, j), w in np.ndenumerate(self.directions)]
        rows += [(0, -1, j, float(p)) for j, p in enumerate(self.phases)]
        rows += [(1, j, 0, -sign * size * float(w)) for j, w in enumerate(self.theta[:-1])]
        return StoredModel([*rows, (1, -1, 0, sign * float(self.theta[-1]))], ["cos", "linear"])
