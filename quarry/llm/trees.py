"""Histogram trees in flat arrays: growing on gradients, and vectorised traversal.

A tree is five arrays over its nodes (feature, threshold, left, right, value);
leaves have feature -1.  A row steps left when its value is at most the node's
threshold (NaN steps left too).  Training rows are a bounded sample, so growing
runs in numpy on the driver; models of a few kB are sent to the tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Tree:
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def predict(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), dtype=np.int32)
        rows = np.arange(len(x))
        for _ in range(self.depth):
            f = self.feature[node]
            right = x[rows, np.maximum(f, 0)] > self.threshold[node]
            node = np.where(f < 0, node, np.where(right, self.right[node], self.left[node]))
        return self.value[node]


def bin_edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Upper edges of at most ``bins`` bins a feature, midway between neighbouring values."""
    edges = []
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        mids = (values[1:] + values[:-1]) / 2
        if len(mids) >= bins:
            mids = np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1]))
        edges.append(mids)
    return edges


def grow(binned: np.ndarray, edges: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, max_depth: int,
         min_rows: int, l2: float, min_gain: float = 1e-9) -> Tree:
    """Best-gain splits level by level from the histograms of gradients and hessians."""
    n_bins = max([len(e) for e in edges], default=0) + 1
    feature, threshold, left, right, value = [], [], [], [], []

    def leaf(rows):
        feature.append(-1)
        threshold.append(0.0)
        left.append(0)
        right.append(0)
        value.append(-grad[rows].sum() / (hess[rows].sum() + l2))
        return len(feature) - 1

    def build(rows, depth):
        node = leaf(rows)
        if depth == max_depth or len(rows) < 2 * min_rows:
            return node, depth
        g_all, h_all = grad[rows].sum(), hess[rows].sum()
        best = (min_gain, -1, 0)
        for f in range(binned.shape[1]):
            if not len(edges[f]):
                continue
            b = binned[rows, f]
            g = np.cumsum(np.bincount(b, grad[rows], n_bins))[:len(edges[f])]
            h = np.cumsum(np.bincount(b, hess[rows], n_bins))[:len(edges[f])]
            n = np.cumsum(np.bincount(b, minlength=n_bins))[:len(edges[f])]
            gain = g * g / np.maximum(h + l2, 1e-12) + (g_all - g) ** 2 / np.maximum(h_all - h + l2, 1e-12) - g_all ** 2 / (h_all + l2)
            gain[(n < min_rows) | (len(rows) - n < min_rows)] = -1
            k = int(np.argmax(gain))
            if gain[k] > best[0] + 1e-12:
                best = (gain[k], f, k)
        if best[1] < 0:
            return node, depth
        _, f, k = best
        go = binned[rows, f] <= k
        feature[node], threshold[node] = f, float(edges[f][k])
        left[node], d1 = build(rows[go], depth + 1)
        right[node], d2 = build(rows[~go], depth + 1)
        return node, max(d1, d2)

    _, depth = build(np.arange(len(grad)), 0)
    return Tree(np.array(feature, np.int32), np.array(threshold), np.array(left, np.int32), np.array(right, np.int32), np.array(value), depth)


def to_bins(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1) if len(edges) else np.zeros((len(x), 0), int)


def fit_tree(x: np.ndarray, y: np.ndarray, max_depth: int = 6, min_rows: int = 1) -> Tree:
    """One classification tree; leaves hold the share of ones (squared-error splits)."""
    edges = bin_edges(x, 256)
    return grow(to_bins(x, edges), edges, -y.astype(float), np.ones(len(y)), max_depth, min_rows, 0.0)


@dataclass(frozen=True)
class Boosted:
    base: float
    rate: float
    trees: tuple[Tree, ...]

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = np.full(len(x), self.base)
        for t in self.trees:
            raw += self.rate * t.predict(x)
        return 1 / (1 + np.exp(-raw))


def fit_boosted(x: np.ndarray, y: np.ndarray, n_trees: int, rate: float, max_depth: int, bins: int = 64,
                min_rows: int = 20, l2: float = 1.0) -> Boosted:
    """Gradient-boosted trees for the logistic loss; one class alone gives its (smoothed) share."""
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    if len(y) < 2 * min_rows or y.min() == y.max():
        return Boosted(base, rate, ())
    edges = bin_edges(x, bins)
    binned = to_bins(x, edges)
    raw, trees = np.full(len(y), base), []
    for _ in range(n_trees):
        p = 1 / (1 + np.exp(-raw))
        t = grow(binned, edges, p - y, p * (1 - p), max_depth, min_rows, l2)
        trees.append(t)
        raw += rate * t.predict(x)
    return Boosted(base, rate, tuple(trees))
