"""Gradient-boosted regression trees for the log loss, in numpy, on binned features."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Trees of a fixed depth, stored as arrays, so that scoring is a few gathers per tree."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, l2: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.l2 = trees, depth, rate, bins, l2
        self.base, self.nodes = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> BoostedTrees:
        weight = np.ones(len(y)) if weight is None else weight
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(q, c, side="right") for q, c in zip(cuts, x.T)], 1)
        mean = min(max(np.average(y, weights=weight), 1e-3), 1 - 1e-3)
        self.base = float(np.log(mean / (1 - mean)))
        z = np.full(len(y), self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-z))
            g, h = (p - y) * weight, np.maximum(p * (1 - p), 1e-6) * weight
            feature, threshold = np.zeros(2**self.depth - 1, int), np.full(2**self.depth - 1, np.inf)
            at = np.zeros(len(y), int)
            for level in range(self.depth):
                first = 2**level - 1
                for node in range(first, 2 * first + 1):
                    mine = at == node
                    if not mine.any():
                        continue
                    gs, hs = g[mine].sum(), h[mine].sum()
                    best = 1e-6
                    for f, q in enumerate(cuts):
                        if not len(q):
                            continue
                        gb = np.bincount(binned[mine, f], g[mine], len(q) + 1).cumsum()[:-1]
                        hb = np.bincount(binned[mine, f], h[mine], len(q) + 1).cumsum()[:-1]
                        gain = gb**2 / (hb + self.l2) + (gs - gb) ** 2 / (hs - hb + self.l2) - gs**2 / (hs + self.l2)
                        k = int(gain.argmax())
                        if gain[k] > best:
                            best, feature[node], threshold[node] = gain[k], f, q[k]
                inner = at >= first
                node = at[inner]
                at[inner] = 2 * node + 1 + (x[inner, feature[node]] >= threshold[node])
            leaf = at - (2**self.depth - 1)
            value = -self.rate * np.bincount(leaf, g, 2**self.depth) / (np.bincount(leaf, h, 2**self.depth) + self.l2)
            self.nodes.append((feature, threshold, value))
            z += value[leaf]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, value in self.nodes:
            at = np.zeros(len(x), int)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] >= threshold[at])
            z += value[at - (2**self.depth - 1)]
        return 1 / (1 + np.exp(-z))


def threshold_for(score: np.ndarray, y: np.ndarray, precision: float | None = None, recall: float | None = None) -> float:
    """The score of the lowest positive at which precision is reached, or the highest score at which recall still is; on data that weren't fitted."""
    if not len(y) or not y.any():
        return 1.1
    order = np.argsort(-score, kind="stable")
    hits = np.cumsum(y[order])
    if precision is not None:
        good = np.flatnonzero((hits / np.arange(1, len(y) + 1) >= precision) & (y[order] == 1))
        return float(score[order[good[-1]]]) if len(good) else 1.1
    need = np.flatnonzero(hits >= recall * y.sum())
    return float(score[order[need[0]]])
