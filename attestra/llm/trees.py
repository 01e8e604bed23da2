"""Gradient-boosted trees on histograms, kept as flat arrays that numpy walks for many rows at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 64


@dataclass(frozen=True)
class Trees:
    """Complete binary trees of one depth: children of node i are 2i+1 and 2i+2, leaves follow the inner nodes.

    An inner node that doesn't split has an infinite threshold, so every row goes left.
    """

    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray  # trees x inner nodes
    leaf: np.ndarray  # trees x leaves
    start: float
    depth: int

    def raw(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += leaf[node - len(feature)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, *, trees: int = 60, depth: int = 4, rate: float = 0.2, l2: float = 1.0, least: float = 2.0) -> Trees:
    """Logistic boosting. With no rows, or one class only, the trees are constant at a smoothed share of ones."""
    inner, n = 2**depth - 1, len(y)
    w = np.ones(n) if weight is None else weight
    share = (float(w @ y) + 0.5) / (float(w.sum()) + 1.0) if n else 0.5
    start = float(np.log(share / (1 - share)))
    if n == 0 or y.min() == y.max():
        trees = 0
    n_features = x.shape[1]
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) if n else np.zeros(0) for f in range(n_features)]
    binned = [np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)]
    raw = np.full(n, start)
    feature, threshold, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = w * (p - y), w * p * (1 - p) + 1e-12
        node = np.zeros(n, np.int64)
        for d in range(depth):
            first, width = 2**d - 1, 2**d
            at = node - first
            best, where = np.full(width, 1e-6), [(-1, 0)] * width
            for f in range(n_features):
                if not len(edges[f]):
                    continue
                k = at * BINS + binned[f]
                gl = np.bincount(k, g, width * BINS).reshape(width, BINS).cumsum(1)
                hl = np.bincount(k, h, width * BINS).reshape(width, BINS).cumsum(1)
                gr, hr = gl[:, -1:] - gl, hl[:, -1:] - hl
                gain = gl**2 / (hl + l2) + gr**2 / (hr + l2) - gl[:, -1:] ** 2 / (hl[:, -1:] + l2)
                gain[(hl < least / 4) | (hr < least / 4)] = 0
                gain[:, len(edges[f]) :] = 0
                top = gain.argmax(1)
                for i in np.flatnonzero(gain[np.arange(width), top] > best):
                    best[i], where[i] = gain[i, top[i]], (f, int(top[i]))
            right = np.zeros(n, bool)
            for i, (f, b) in enumerate(where):
                if f >= 0:
                    feature[t, first + i], threshold[t, first + i] = f, edges[f][b]
                    right |= (at == i) & (binned[f] > b)
            node = 2 * node + 1 + right
        k = node - inner
        leaf[t] = -rate * np.bincount(k, g, inner + 1) / (np.bincount(k, h, inner + 1) + l2)
        raw += leaf[t][k]
    return Trees(feature, threshold, leaf, start, depth)
