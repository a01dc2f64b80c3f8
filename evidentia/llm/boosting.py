"""Gradient-boosted regression trees for two classes, trained in memory on a bounded sample."""

from __future__ import annotations

import numpy as np


class Booster:
    """Logistic loss, second-order leaf values, splits between quantiles."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 24, least: float = 4.0):
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least
        self.base, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Booster:
        if not len(x) or y.min() == y.max():
            self.base = -4.0 if not len(x) or not y[0] else 4.0
            return self
        edges = [np.unique(np.quantile(column, np.linspace(0, 1, self.bins + 1)[1:-1])) for column in x.T]
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], 1)
        weight = np.ones(len(y)) if weight is None else weight
        share = float(np.average(y, weights=weight))
        self.base = float(np.log(share / (1 - share)))
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(binned, edges, weight * (p - y), weight * p * (1 - p), np.arange(len(y)), self.depth)
            self.trees.append(tree)
            score += self._walk(tree, x)
        return self

    def _grow(self, binned: np.ndarray, edges: list, g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int):
        total_g, total_h = g[rows].sum(), h[rows].sum()
        leaf = -self.rate * total_g / (total_h + 1.0)
        if depth == 0 or total_h < 2 * self.least:
            return leaf
        best = (1e-6, -1, -1)
        for f, edge in enumerate(edges):
            if not len(edge):
                continue
            left_g = np.bincount(binned[rows, f], g[rows], len(edge) + 1).cumsum()[:-1]
            left_h = np.bincount(binned[rows, f], h[rows], len(edge) + 1).cumsum()[:-1]
            right_g, right_h = total_g - left_g, total_h - left_h
            gain = left_g**2 / (left_h + 1) + right_g**2 / (right_h + 1) - total_g**2 / (total_h + 1)
            gain[(left_h < self.least) | (right_h < self.least)] = 0
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), f, k)
        if best[1] < 0:
            return leaf
        _, f, k = best
        low = binned[rows, f] <= k
        return f, float(edges[f][k]), self._grow(binned, edges, g, h, rows[low], depth - 1), self._grow(binned, edges, g, h, rows[~low], depth - 1)

    def _walk(self, tree, x: np.ndarray) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        f, edge, left, right = tree
        return np.where(x[:, f] <= edge, self._walk(left, x), self._walk(right, x))

    def probability(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        return 1 / (1 + np.exp(-(self.base + sum((self._walk(t, x) for t in self.trees), np.zeros(len(x))))))
