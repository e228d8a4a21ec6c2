"""Gradient-boosted regression trees for a logistic loss, in numpy."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Trees of a fixed depth over binned features; prediction is a few array look-ups a tree."""

    def __init__(self, rounds: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 32, ridge: float = 1.0, least: int = 8):
        self.rounds, self.depth, self.rate, self.bins, self.ridge, self.least = rounds, depth, rate, bins, ridge, least

    def _binned(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(x.shape, np.uint8)
        for j, edges in enumerate(self.edges):
            out[:, j] = np.searchsorted(edges, x[:, j], "right")
        return out

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Boosted":
        quantiles = np.linspace(0, 1, self.bins + 1)[1:-1]
        self.edges = [np.unique(np.quantile(c, quantiles)) for c in x.T]
        b = self._binned(x)
        p = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.base = float(np.log(p / (1 - p)))
        z = np.full(len(y), self.base)
        inner = (1 << self.depth) - 1
        self.feature = np.zeros((self.rounds, inner), np.int64)
        self.cut = np.full((self.rounds, inner), 255, np.uint8)
        self.value = np.zeros((self.rounds, 1 << self.depth))
        for t in range(self.rounds):
            q = 1 / (1 + np.exp(-z))
            g, h = y - q, q * (1 - q)
            node = np.zeros(len(y), np.int64)
            for level in range(self.depth):
                first, width = (1 << level) - 1, 1 << level
                best = np.full(width, 1e-6)
                local = node - first
                for j in range(x.shape[1]):
                    key = local * self.bins + b[:, j]
                    sums = [np.bincount(key, w, width * self.bins).reshape(width, self.bins) for w in (g, h, None)]
                    left = [s.cumsum(1) for s in sums]
                    right = [s[:, -1:] - s for s in left]
                    gain = left[0] ** 2 / (left[1] + self.ridge) + right[0] ** 2 / (right[1] + self.ridge) - left[0][:, -1:] ** 2 / (left[1][:, -1:] + self.ridge)
                    gain[(left[2] < self.least) | (right[2] < self.least)] = 0
                    at = gain.argmax(1)
                    top = gain[np.arange(width), at]
                    better = top > best
                    best[better] = top[better]
                    self.feature[t, first : first + width][better] = j
                    self.cut[t, first : first + width][better] = at[better]
                node = 2 * node + 1 + (b[np.arange(len(y)), self.feature[t, node]] > self.cut[t, node])
            leaf = node - inner
            gs, hs = (np.bincount(leaf, w, 1 << self.depth) for w in (g, h))
            self.value[t] = self.rate * gs / (hs + self.ridge)
            z += self.value[t, leaf]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Log-odds."""
        b = self._binned(x)
        rows, z = np.arange(len(x)), np.full(len(x), self.base)
        for t in range(self.rounds):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (b[rows, self.feature[t, node]] > self.cut[t, node])
            z += self.value[t, node - (1 << self.depth) + 1]
        return z
