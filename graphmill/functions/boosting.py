"""Gradient-boosted regression trees on binned columns, for samples that fit into one task."""

from __future__ import annotations

import numpy as np

BINS = 64


def binned(x: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Each column's values as numbers of bins of about equal counts."""
    out = np.empty(x.shape, np.uint8)
    for j in range(x.shape[1]):
        edges = np.unique(np.quantile(x[:, j], np.arange(1, bins) / bins))
        out[:, j] = np.searchsorted(edges, x[:, j], "right")
    return out


def _tree(b: np.ndarray, g: np.ndarray, test: np.ndarray, depth: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """What one tree on residuals g adds to the rows of b and of test: every level splits each node where the squared error
    falls most, and a leaf gives its mean."""
    node, node_t, k = np.zeros(len(b), np.int64), np.zeros(len(test), np.int64), 1
    for _ in range(depth):
        best = np.zeros(k)
        feature, cut = np.full(k, -1), np.zeros(k, np.int64)
        n_all, s_all = np.bincount(node, minlength=k), np.bincount(node, g, k)
        for j in range(b.shape[1]):
            at = node * BINS + b[:, j]
            n, s = (np.bincount(at, w, k * BINS).reshape(k, BINS).cumsum(axis=1)[:, :-1] for w in (None, g))
            rest, sum_rest = n_all[:, None] - n, s_all[:, None] - s
            ok = (n >= least) & (rest >= least)
            gain = np.where(ok, s**2 / np.maximum(n, 1) + sum_rest**2 / np.maximum(rest, 1) - (s_all**2 / np.maximum(n_all, 1))[:, None], 0)
            where = gain.argmax(axis=1)
            top = gain[np.arange(k), where]
            better = top > best + 1e-12
            best[better], feature[better], cut[better] = top[better], j, where[better]
        split = feature >= 0
        for at, rows in ((node, b), (node_t, test)):
            f = feature[at]
            right = split[at] & (rows[np.arange(len(rows)), np.maximum(f, 0)] > cut[at])
            at *= 2
            at += right
        k *= 2
    leaf = np.bincount(node, g, k) / np.maximum(np.bincount(node, minlength=k), 1)
    return leaf[node], leaf[node_t]


def held_out_r2(x: np.ndarray, y: np.ndarray, held: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.2, least: int = 20) -> float:
    """R2, on the rows held out, of boosted trees fitted to the others. Without a column the mean is the fit."""
    b, (fit, out) = binned(x), (~held, held)
    mean = float(y[fit].mean())
    at, guess = np.full(int(fit.sum()), mean), np.full(int(out.sum()), mean)
    if x.shape[1]:
        for _ in range(trees):
            step, step_t = _tree(b[fit], y[fit] - at, b[out], depth, least)
            at += rate * step
            guess += rate * step_t
    total = float(((y[out] - y[out].mean()) ** 2).sum())
    return 1 - float(((y[out] - guess) ** 2).sum()) / total if total > 0 else 0.0
