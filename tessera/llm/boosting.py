"""Gradient-boosted trees on the logistic loss in numpy: small data, few features, fixed seeds."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Depth-limited trees over quantile bins; ``predict`` gives probabilities."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.25, l2: float = 1.0, bins: int = 32):
        self.rounds, self.depth, self.rate, self.l2, self.bins = rounds, depth, rate, l2, bins

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        coded = np.stack([np.searchsorted(q, c, side="left") for q, c in zip(cuts, x.T, strict=True)], 1)
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(rate / (1 - rate)))
        self.trees, raw = [], np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-raw))
            tree = self._grow(coded, cuts, p - y, p * (1 - p), np.arange(len(y)), self.depth)
            self.trees.append(tree)
            raw += self._apply(tree, x)
        return self

    def _grow(self, coded, cuts, g, h, rows, depth):
        total_g, total_h = g[rows].sum(), h[rows].sum()
        leaf = -self.rate * total_g / (total_h + self.l2)
        if depth == 0 or len(rows) < 10:
            return leaf
        best, split = 1e-6, None
        for f in range(coded.shape[1]):
            n = len(cuts[f]) + 1
            if n == 1:
                continue
            gs = np.cumsum(np.bincount(coded[rows, f], g[rows], n))[:-1]
            hs = np.cumsum(np.bincount(coded[rows, f], h[rows], n))[:-1]
            gain = gs**2 / (hs + self.l2) + (total_g - gs) ** 2 / (total_h - hs + self.l2) - total_g**2 / (total_h + self.l2)
            k = int(np.argmax(gain))
            if gain[k] > best:
                best, split = gain[k], (f, k)
        if split is None:
            return leaf
        f, k = split
        left = coded[rows, f] <= k
        return f, float(cuts[f][k]), self._grow(coded, cuts, g, h, rows[left], depth - 1), self._grow(coded, cuts, g, h, rows[~left], depth - 1)

    def _apply(self, tree, x: np.ndarray) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        f, cut, left, right = tree
        out, low = np.empty(len(x)), x[:, f] <= cut
        out[low], out[~low] = self._apply(left, x[low]), self._apply(right, x[~low])
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        raw = np.full(len(x), self.base)
        for tree in self.trees:
            raw += self._apply(tree, x)
        return 1 / (1 + np.exp(-raw))


def threshold_for_precision(p: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The smallest threshold from which held-out precision is at least ``precision``; above 1 where there is none."""
    order = np.argsort(-p, kind="stable")
    reached = np.cumsum(y[order]) / np.arange(1, len(y) + 1) >= precision
    ends = np.r_[np.diff(p[order]) != 0, True]
    good = np.flatnonzero(reached & ends)
    return float(p[order][good[-1]]) if len(good) else 2.0
