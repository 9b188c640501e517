"""Histogram gradient-boosted trees for binary labels, flattened into arrays.

Training takes a bounded matrix of features; prediction walks all rows through a tree at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Node arrays, one row a tree: feature (-1: leaf), threshold, left child (right is next), value."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    bias: float
    depth: int

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of every row of ``x``; missing values (nan) go left."""
        out = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for t in range(len(self.feature)):
            at = np.zeros(len(x), np.int32)
            for _ in range(self.depth):
                feature = self.feature[t, at]
                inner = feature >= 0
                right = x[rows, np.maximum(feature, 0)] > self.threshold[t, at]
                at = np.where(inner, self.left[t, at] + right, at)
            out += self.value[t, at]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def train(
    x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, n_trees: int = 80, depth: int = 4, rate: float = 0.1,
    n_bins: int = 64, ridge: float = 1.0, min_rows: float = 10.0,
) -> Trees:
    """Boost ``n_trees`` trees of ``depth`` levels on the logistic loss.

    Features are binned at quantiles once; each level adds up gradients and curvatures in one
    histogram over (node, feature, bin) and every node takes its best cut. ``min_rows`` is the
    least weight of a child. Without rows or with one label only the trees are leaves.
    """
    n, n_features = x.shape if x.ndim == 2 else (0, 1)
    weight = np.ones(n) if weight is None else weight
    share = (float((weight * y).sum()) + 0.5) / (float(weight.sum()) + 1.0)
    bias = float(np.log(share / (1 - share)))
    size = 2 ** (depth + 1)
    shape = (n_trees, size)
    trees = Trees(np.full(shape, -1, np.int32), np.zeros(shape), np.zeros(shape, np.int32), np.zeros(shape), bias, depth)
    if n == 0 or y.min() == y.max():
        return trees
    x = np.nan_to_num(x, nan=-np.inf)
    cuts = [np.unique(np.quantile(c[np.isfinite(c)], np.linspace(0, 1, n_bins + 1)[1:-1])) if np.isfinite(c).any() else np.zeros(0) for c in x.T]
    bins = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], axis=1).astype(np.int64)
    raw = np.full(n, bias)
    columns = np.arange(n_features) * n_bins
    for t in range(n_trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = weight * (y - p), weight * np.maximum(p * (1 - p), 1e-9)
        node = np.zeros(n, np.int64)
        used = 1
        open_nodes = [0]
        for _ in range(depth):
            cell = (node[:, None] * (n_features * n_bins) + columns[None, :] + bins).ravel()
            cells = (used, n_features, n_bins)
            total = int(np.prod(cells))
            gs, hs, ws = (np.bincount(cell, np.repeat(v, n_features), total).reshape(cells).cumsum(axis=2) for v in (g, h, weight))
            fresh = []
            for k in open_nodes:
                all_g, all_h, all_w = gs[k, 0, -1], hs[k, 0, -1], ws[k, 0, -1]
                gain = gs[k] ** 2 / (hs[k] + ridge) + (all_g - gs[k]) ** 2 / (all_h - hs[k] + ridge) - all_g**2 / (all_h + ridge)
                gain[(ws[k] < min_rows) | (all_w - ws[k] < min_rows)] = 0
                f, b = np.unravel_index(int(gain.argmax()), gain.shape)
                if gain[f, b] <= 1e-9 or b >= len(cuts[f]):
                    continue
                trees.feature[t, k], trees.threshold[t, k], trees.left[t, k] = f, cuts[f][b], used
                here = node == k
                node[here] = used + (bins[here, f] > b)
                fresh += [used, used + 1]
                used += 2
            open_nodes = fresh
            if not fresh:
                break
        leaf_g, leaf_h = np.bincount(node, g, size), np.bincount(node, h, size)
        trees.value[t] = rate * leaf_g / (leaf_h + ridge)
        raw += trees.value[t, node]
    return trees


def calibrate(raw: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and intercept that turn log-odds into calibrated log-odds (logistic, light ridge)."""
    if not len(y) or y.min() == y.max():
        return 1.0, 0.0
    x, w = np.stack([raw, np.ones(len(raw))], axis=1), np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        pull = np.array([0.1 * (w[0] - 1.0), 0.01 * w[1]])
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag([0.1, 0.01]), x.T @ (y - p) - pull)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])
