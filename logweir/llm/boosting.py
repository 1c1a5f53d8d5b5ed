"""Gradient-boosted trees for a yes/no label, on binned features, in numpy."""

from __future__ import annotations

import numpy as np

BINS = 32


class BoostedTrees:
    """Trees of a fixed depth fitted one after another to the gradient of the log loss.

    ``fit`` takes a bounded training table; ``margin`` scores any number of rows."""

    def __init__(self, trees: int = 40, depth: int = 4, rate: float = 0.25, smooth: float = 5.0) -> None:
        self.trees, self.depth, self.rate, self.smooth = trees, depth, rate, smooth
        self.base, self.feature, self.cut, self.leaf, self.edges = 0.0, [], [], [], None

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], 1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        b, n_features = self._binned(x), x.shape[1]
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        score = np.full(len(y), self.base)
        for _ in range(self.trees):
            prob = 1 / (1 + np.exp(-score))
            g, h = y - prob, prob * (1 - prob)
            node = np.zeros(len(y), np.int64)
            feats, cuts = [], []
            for level in range(self.depth):
                width = 1 << level
                best = np.full(width, 1e-9)
                f_of, c_of = np.zeros(width, np.int64), np.full(width, BINS + 1)
                for j in range(n_features):
                    cell = node * (BINS + 1) + b[:, j]
                    gs = np.bincount(cell, g, width * (BINS + 1)).reshape(width, -1).cumsum(1)
                    hs = np.bincount(cell, h, width * (BINS + 1)).reshape(width, -1).cumsum(1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + self.smooth) + (gt - gs) ** 2 / (ht - hs + self.smooth) - gt**2 / (ht + self.smooth)
                    at = gain.argmax(1)
                    top = gain[np.arange(width), at]
                    better = top > best
                    best[better], f_of[better], c_of[better] = top[better], j, at[better]
                feats.append(f_of)
                cuts.append(c_of)
                node = 2 * node + (b[np.arange(len(y)), f_of[node]] > c_of[node])
            gl, hl = np.bincount(node, g, 1 << self.depth), np.bincount(node, h, 1 << self.depth)
            leaf = self.rate * gl / (hl + self.smooth)
            score += leaf[node]
            self.feature.append(feats)
            self.cut.append(cuts)
            self.leaf.append(leaf)
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row."""
        b = self._binned(x)
        score, rows = np.full(len(x), self.base), np.arange(len(x))
        for feats, cuts, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            for f, c in zip(feats, cuts):
                node = 2 * node + (b[rows, f[node]] > c[node])
            score += leaf[node]
        return score
