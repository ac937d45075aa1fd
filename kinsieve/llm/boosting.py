"""Gradient boosted trees for a binary target: logistic loss, histogram splits, Newton leaves (Friedman, 2001)."""

from __future__ import annotations

import numpy as np

BINS = 32


class Boosted:
    """Trees of fixed depth in arrays: feature, cut and leaf values; a row's leaf is found by array operations."""

    def __init__(self, trees: int = 60, depth: int = 4, rate: float = 0.2, ridge: float = 1.0, least: int = 5):
        self.trees, self.depth, self.rate, self.ridge, self.least = trees, depth, rate, ridge, least
        self.bias, self.feature, self.cut, self.leaf = 0.0, np.zeros((0, 0), int), np.zeros((0, 0)), np.zeros((0, 0))

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        n, d = x.shape
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(d)]
        binned = np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)], 1)
        self.bias = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        f, nodes = np.full(n, self.bias), 2**self.depth - 1
        features, cuts, leaves = [], [], []
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, np.maximum(p * (1 - p), 1e-6)
            at, feature, cut = np.zeros(n, int), np.zeros(nodes, int), np.full(nodes, np.inf)
            for level in range(self.depth):
                first = 2**level - 1
                for node in range(first, 2 * first + 1):
                    own = np.flatnonzero(at == node)
                    if len(own) >= 2 * self.least and (best := self._split(binned[own], g[own], h[own], edges)):
                        feature[node], cut[node] = best
                here = np.arange(n)
                right = x[here, feature[at]] >= cut[at]
                at = 2 * at + 1 + right
            leaf = np.zeros(2**self.depth)
            top, low = np.bincount(at - nodes, g, len(leaf)), np.bincount(at - nodes, h, len(leaf))
            leaf = self.rate * top / (low + self.ridge)
            f = f + leaf[at - nodes]
            features.append(feature), cuts.append(cut), leaves.append(leaf)
        self.feature, self.cut, self.leaf = np.array(features), np.array(cuts), np.array(leaves)
        return self

    def _split(self, b: np.ndarray, g: np.ndarray, h: np.ndarray, edges: list[np.ndarray]) -> tuple[int, float] | None:
        best, found, whole = 1e-9, None, g.sum() ** 2 / (h.sum() + self.ridge)
        for j, e in enumerate(edges):
            if not len(e):
                continue
            gs, hs, ns = (np.cumsum(np.bincount(b[:, j], w, len(e) + 1))[:-1] for w in (g, h, None))
            gain = gs**2 / (hs + self.ridge) + (g.sum() - gs) ** 2 / (h.sum() - hs + self.ridge) - whole
            gain[(ns < self.least) | (len(b) - ns < self.least)] = -1
            k = int(gain.argmax())
            if gain[k] > best:
                best, found = gain[k], (j, float(e[k]))
        return found

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row."""
        out, here, nodes = np.full(len(x), self.bias), np.arange(len(x)), 2**self.depth - 1
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), int)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[here, feature[at]] >= cut[at])
            out += leaf[at - nodes]
        return out
