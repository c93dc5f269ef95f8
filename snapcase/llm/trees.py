"""Gradient-boosted trees for two classes, fitted on a bounded sample in memory.

Trees are symmetric: every node of a level asks the same question, so a tree of depth d
is d (feature, threshold) pairs and 2^d leaf values, and prediction is a few vector
operations.  Thresholds are quantiles of the sample.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    base: float
    features: np.ndarray      # trees x depth
    thresholds: np.ndarray    # trees x depth
    leaves: np.ndarray        # trees x 2^depth

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log odds of class 1 for each row of ``x``."""
        out = np.full(len(x), self.base)
        for feature, threshold, leaf in zip(self.features, self.thresholds, self.leaves):
            at = np.zeros(len(x), dtype=np.int64)
            for f, t in zip(feature, threshold):
                at = 2 * at + (x[:, f] > t)
            out += leaf[at]
        return out


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2,
        bins: int = 32, ridge: float = 1.0) -> Trees:
    """Boosted trees for labels ``y`` (0/1); one class or no row gives a constant."""
    n, width = x.shape
    share = (y.sum() + 0.5) / (n + 1)
    model = Trees(float(np.log(share / (1 - share))), np.zeros((0, depth), int),
                  np.zeros((0, depth)), np.zeros((0, 2**depth)))
    if n == 0 or y.min() == y.max():
        return model
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1]))
             for f in range(width)]
    binned = [np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)]
    margin = np.full(n, model.base)
    for _ in range(trees):
        p = sigmoid(margin)
        gradient, weight = y - p, p * (1 - p)
        leaf = np.zeros(n, dtype=np.int64)
        questions = []
        for level in range(depth):
            best = (-1.0, 0, 0)
            for f in range(width):
                k = len(edges[f]) + 1
                cell = leaf * k + binned[f]
                size = (1 << level) * k
                g = np.bincount(cell, gradient, size).reshape(-1, k).cumsum(1)
                h = np.bincount(cell, weight, size).reshape(-1, k).cumsum(1)
                rest_g, rest_h = g[:, -1:] - g, h[:, -1:] - h
                gain = (g**2 / (h + ridge) + rest_g**2 / (rest_h + ridge)).sum(0)[:-1]
                if len(gain) and gain.max() > best[0]:
                    best = (float(gain.max()), f, int(gain.argmax()))
            _, f, cut = best
            questions.append((f, edges[f][cut] if len(edges[f]) else np.inf))
            leaf = 2 * leaf + (x[:, f] > questions[-1][1])
        g = np.bincount(leaf, gradient, 2**depth)
        h = np.bincount(leaf, weight, 2**depth)
        value = rate * g / (h + ridge)
        margin += value[leaf]
        model.features = np.vstack((model.features, [[q[0] for q in questions]]))
        model.thresholds = np.vstack((model.thresholds, [[q[1] for q in questions]]))
        model.leaves = np.vstack((model.leaves, [value]))
    return model
