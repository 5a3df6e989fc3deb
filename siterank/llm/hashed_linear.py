"""Logistic regression over hashed binary features, trained on a bounded sample by full-batch steps."""

from __future__ import annotations

import numpy as np


class Rows:
    """Sparse binary rows: feature ids of all rows in order and the number in each row."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        self.ids, self.lengths = np.asarray(ids, dtype=np.int64), np.asarray(lengths, dtype=np.int64)
        self.row = np.repeat(np.arange(len(self.lengths)), self.lengths)

    def scores(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights[self.ids], len(self.lengths))

    def back(self, values: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.ids, values[self.row], width)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(rows: Rows, target: np.ndarray, weight: np.ndarray, width: int, l2: float, steps: int = 150, rate: float = 0.1, pairs: tuple[Rows, Rows] | None = None, pair_weight: float = 0.0) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise weighted log loss + ``l2`` |w|^2 / 2 + ``pair_weight`` mean (score change)^2 of ``pairs``."""
    w, b, total = np.zeros(width), 0.0, max(weight.sum(), 1e-9)
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for t in range(1, steps + 1):
        err = (sigmoid(rows.scores(w) + b) - target) * weight / total
        g = np.append(rows.back(err, width) + l2 * w, err.sum())
        if pairs is not None and len(pairs[0].lengths):
            change = (pairs[0].scores(w) - pairs[1].scores(w)) * 2 * pair_weight / len(pairs[0].lengths)
            g[:-1] += pairs[0].back(change, width) - pairs[1].back(change, width)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return w, b
