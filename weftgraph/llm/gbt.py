"""Gradient-boosted trees with logistic loss, small enough to train on the spot.

Histogram splits on quantile bins, second-order leaf values, level-wise trees
of fixed depth held in arrays, so that a batch is scored by array look-ups.
"""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Binary classifier; ``decision`` gives log-odds."""

    def __init__(self, rounds: int = 60, depth: int = 5, rate: float = 0.25, bins: int = 48, l2: float = 1.0, least: float = 2.0):
        self.rounds, self.depth, self.rate, self.bins, self.l2, self.least = rounds, depth, rate, bins, l2, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> "BoostedTrees":
        n, f = x.shape
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(f)]
        binned = self._bin(x)
        width = self.bins + 1
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        score = np.full(n, self.base)
        inner, leaves = 2**self.depth - 1, 2**self.depth
        self.feature = np.zeros((self.rounds, inner), np.int32)
        self.cut = np.full((self.rounds, inner), width, np.int32)
        self.leaf = np.zeros((self.rounds, leaves))
        flat = binned + (np.arange(f, dtype=np.int64) * width)[None, :]
        for r in range(self.rounds):
            q = 1 / (1 + np.exp(-score))
            g, h = q - y, q * (1 - q)
            at = np.zeros(n, np.int64)
            for level in range(self.depth):
                k = 2**level
                slots = (at[:, None] * (f * width) + flat).ravel()
                gs = np.bincount(slots, np.repeat(g, f), k * f * width).reshape(k, f, width).cumsum(2)
                hs = np.bincount(slots, np.repeat(h, f), k * f * width).reshape(k, f, width).cumsum(2)
                gt, ht = gs[:, :, -1:], hs[:, :, -1:]
                gain = gs**2 / (hs + self.l2) + (gt - gs) ** 2 / (ht - hs + self.l2) - gt**2 / (ht + self.l2)
                gain[(hs < self.least) | (ht - hs < self.least)] = 0
                best = gain.reshape(k, -1).argmax(1)
                fine = gain.reshape(k, -1)[np.arange(k), best] > 1e-9
                feature, cut = np.where(fine, best // width, 0), np.where(fine, best % width, width)
                self.feature[r, k - 1 : 2 * k - 1], self.cut[r, k - 1 : 2 * k - 1] = feature, cut
                at = at * 2 + (binned[np.arange(n), feature[at]] > cut[at])
            gl, hl = np.bincount(at, g, leaves), np.bincount(at, h, leaves)
            self.leaf[r] = -self.rate * gl / (hl + self.l2)
            score += self.leaf[r][at]
        return self

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], 1).astype(np.int64)

    def decision(self, x: np.ndarray) -> np.ndarray:
        binned = self._bin(x)
        rows = np.arange(len(x))
        score = np.full(len(x), self.base)
        for r in range(self.rounds):
            at = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                k = 2**level - 1
                at = at * 2 + (binned[rows, self.feature[r, k + at]] > self.cut[r, k + at])
            score += self.leaf[r][at]
        return score
