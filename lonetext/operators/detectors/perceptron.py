from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame

from .base import moments
from .deep import _scaled, _Trained
from .gradient import Net
from .stored import StoredModel, hidden_then_linear, scaling, shifted


def logistic_loss(z: np.ndarray, known: np.ndarray):
    """Summed cross entropy of the log-odds `z`, and its gradient."""
    value = np.logaddexp(0.0, np.where(known, -z, z)).sum()
    return value, 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500))) - known


class MLP(_Trained):
    """Feed-forward classifier on the known labels: one layer of ReLU units, Adam on cross entropy, standardised input.

    The score is the probability of class 1.
    """

    uses_labels = True

    def __init__(self, hidden: Sequence[int] = (100,), penalty: float = 1e-4, max_iter: int | None = None, **loop):
        """`max_iter` is another name of `epochs`."""
        super().__init__(**loop if max_iter is None else {**loop, "epochs": max_iter})
        self.hidden, self.penalty = list(hidden), penalty

    def fit(self, train: DataFrame) -> "MLP":
        dim = self._start(train, decay=self.penalty)
        net, m = Net([dim, *self.hidden, 1]), moments(self.loop.table)

        def loss(theta, batch, step):
            values = net.forward(theta, _scaled(batch.x, m.mean, m.scale))
            value, out = logistic_loss(values[-1][:, 0], batch.known)
            return value, net.backward(theta, values, out[:, None])[0]

        self.net, self.moments = net, m
        self.theta = self.loop.minimise(loss, net.initial(np.random.default_rng(self.seed)))
        return self

    def score(self, rows: DataFrame) -> DataFrame:
        net = self.net

        def chance(state, x):
            theta, mean, scale = state
            return 1.0 / (1.0 + np.exp(-np.clip(net.forward(theta, _scaled(x, mean, scale))[-1][:, 0], -500, 500)))

        return self._scored(rows, chance, (self.theta, self.moments.mean, self.moments.scale))

    def stored(self) -> StoredModel:
        """Its score is the log-odds."""
        rows = scaling(self.moments.mean, self.moments.scale) + shifted(self.net.as_rows(self.theta), 1)
        return StoredModel(rows, ["linear", *hidden_then_linear(len(self.net.shapes))])
