"""Gradient-boosted stumps in numpy: small enough to be fitted on the driver from a bounded sample."""

from __future__ import annotations

import numpy as np


class Boost:
    """Logistic gradient boosting of one-split trees over binned features.

    ``rounds`` stumps at most; ``cuts`` thresholds a feature.  Rows without any of the two labels
    give a model that answers with the share of positives.
    """

    def __init__(self, rounds: int = 80, rate: float = 0.3, cuts: int = 24) -> None:
        self.rounds, self.rate, self.cuts = rounds, rate, cuts
        self.base, self.stumps = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boost:
        x, y = np.asarray(x, float), np.asarray(y, float)
        p = min(max(y.mean(), 1e-3), 1 - 1e-3) if len(y) else 0.001
        self.base = float(np.log(p / (1 - p)))
        if not len(y) or y.min() == y.max():
            return self
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.cuts + 1)[:-1])) for j in range(x.shape[1])]
        sides = [x[:, j][:, None] > e[None, :] for j, e in enumerate(edges)]
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-score))
            g, h = y - q, q * (1 - q)
            best = (1e-6, None)
            gs, hs = g.sum(), h.sum() + 1.0
            for j, s in enumerate(sides):
                gr, hr = g @ s, h @ s + 1.0
                gain = gr**2 / hr + (gs - gr) ** 2 / (hs - hr + 2.0) - gs**2 / hs
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (float(gain[k]), (j, float(edges[j][k]), float((gs - gr[k]) / (hs - hr[k] + 2.0)), float(gr[k] / hr[k])))
            if best[1] is None:
                break
            j, at, left, right = best[1]
            self.stumps.append((j, at, self.rate * left, self.rate * right))
            score += np.where(x[:, j] > at, self.rate * right, self.rate * left)
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, float)
        score = np.full(len(x), self.base)
        for j, at, left, right in self.stumps:
            score += np.where(x[:, j] > at, right, left)
        return 1 / (1 + np.exp(-score))
