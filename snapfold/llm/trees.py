"""Gradient-boosted trees of fixed depth over binned features, small enough to train on the driver from a bounded sample."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


class Tree(NamedTuple):
    """A complete binary tree: node i has children 2i+1 and 2i+2; a row goes right where x > threshold."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    """Cut points between distinct values, at quantiles."""
    values = np.unique(x)
    if len(values) <= 1:
        return np.empty(0)
    middles = (values[1:] + values[:-1]) / 2
    if len(middles) > bins - 1:
        middles = np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))
    return middles


def _grow(codes, edges, g, h, depth, bins, least, ridge):
    n, f = codes.shape
    node = np.zeros(n, dtype=np.int64)
    feature, threshold = np.zeros(2**depth - 1, dtype=np.int64), np.full(2**depth - 1, np.inf)
    for level in range(depth):
        first, width = 2**level - 1, 2**level
        key = ((node - first)[:, None] * f + np.arange(f)) * bins + codes
        size = width * f * bins
        G = np.bincount(key.ravel(), np.repeat(g, f), size).reshape(width, f, bins).cumsum(2)
        H = np.bincount(key.ravel(), np.repeat(h, f), size).reshape(width, f, bins).cumsum(2)
        g_all, h_all = G[:, :1, -1:], H[:, :1, -1:]
        gain = G**2 / (H + ridge) + (g_all - G) ** 2 / (h_all - H + ridge) - g_all**2 / (h_all + ridge)
        gain[(H < least) | (h_all - H < least)] = 0
        best = gain.reshape(width, -1).argmax(1)
        cut_at = np.full(width, bins)
        split_on = np.zeros(width, dtype=np.int64)
        for i in range(width):
            if gain[i].flat[best[i]] > 1e-9:
                split_on[i], cut_at[i] = divmod(best[i], bins)
                feature[first + i], threshold[first + i] = split_on[i], edges[split_on[i]][cut_at[i]]
        at = node - first
        node = 2 * node + 1 + (codes[np.arange(n), split_on[at]] > cut_at[at])
    leaf = node - (2**depth - 1)
    G, H = np.bincount(leaf, g, 2**depth), np.bincount(leaf, h, 2**depth)
    return Tree(feature, threshold, -G / (H + ridge)), leaf


def boost(X, y, weight=None, trees=40, depth=4, rate=0.3, bins=32, least=2.0, ridge=1.0):
    """Boosted trees for a 0/1 target under logistic loss: (base score, trees with the learning rate in their values)."""
    X, y = np.asarray(X, dtype=float), np.asarray(y, dtype=float)
    weight = np.ones(len(y)) if weight is None else np.asarray(weight, dtype=float)
    edges = [_edges(X[:, j], bins) for j in range(X.shape[1])]
    codes = np.column_stack([np.searchsorted(e, X[:, j], side="left") for j, e in enumerate(edges)])
    mean = np.clip((weight * y).sum() / weight.sum(), 1e-3, 1 - 1e-3)
    base = float(np.log(mean / (1 - mean)))
    score, out = np.full(len(y), base), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        tree, leaf = _grow(codes, edges, weight * (p - y), weight * p * (1 - p), depth, bins, least, ridge)
        tree = tree._replace(value=tree.value * rate)
        score += tree.value[leaf]
        out.append(tree)
    return base, out


def leaves(tree: Tree, X: np.ndarray) -> np.ndarray:
    node, rows = np.zeros(len(X), dtype=np.int64), np.arange(len(X))
    for _ in range(len(tree.value).bit_length() - 1):
        node = 2 * node + 1 + (X[rows, tree.feature[node]] > tree.threshold[node])
    return node - (len(tree.value) - 1)


def log_odds(model, X: np.ndarray) -> np.ndarray:
    base, trees = model
    out = np.full(len(X), base)
    for tree in trees:
        out += tree.value[leaves(tree, X)]
    return out


def paths(tree: Tree) -> list[tuple[tuple[int, bool, float], ...]]:
    """Every path from the root to an inner node's child, as conjunctions of (feature, is greater, threshold)."""
    out = []

    def walk(i, so_far):
        if so_far:
            out.append(tuple(so_far))
        if i < len(tree.feature):
            if np.isfinite(tree.threshold[i]):
                for greater in (False, True):
                    walk(2 * i + 1 + greater, [*so_far, (int(tree.feature[i]), greater, float(tree.threshold[i]))])

    walk(0, [])
    return out
