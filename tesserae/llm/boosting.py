"""Gradient-boosted trees for two classes, fitted on histograms of binned features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 32


@dataclass
class Forest:
    """Complete binary trees of one depth as arrays: feature and limit per inner node, value per leaf."""

    base: float
    features: np.ndarray
    limits: np.ndarray
    values: np.ndarray

    def chances(self, x: np.ndarray) -> np.ndarray:
        """The probability of class 1 per row."""
        score = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, limit, value in zip(self.features, self.limits, self.values):
            node = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(len(value)))):
                node = 2 * node + 1 + (x[rows, feature[node]] > limit[node])
            score += value[node - len(feature)]
        return 1 / (1 + np.exp(-np.clip(score, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 4, rate: float = 0.3, ridge: float = 1.0) -> Forest:
    """Newton boosting of the logistic loss; a node that no split improves sends all rows to its left."""
    n, width = x.shape
    limits = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS)[1:-1], method="lower")) for j in range(width)]
    binned = np.stack([np.searchsorted(limits[j], x[:, j], side="left") for j in range(width)], axis=1)
    share = (y.sum() + 1) / (n + 2)
    base = float(np.log(share / (1 - share)))
    score = np.full(n, base)
    inner = 2**depth - 1
    features, cuts, values = [], [], []
    for _ in range(trees):
        chance = 1 / (1 + np.exp(-score))
        slope, bend = chance - y, np.maximum(chance * (1 - chance), 1e-6)
        feature, cut, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(n, np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            best, place = np.zeros(count), node - first
            for j in range(width):
                key = place * BINS + binned[:, j]
                g = np.bincount(key, slope, count * BINS).reshape(count, BINS).cumsum(axis=1)
                h = np.bincount(key, bend, count * BINS).reshape(count, BINS).cumsum(axis=1)
                all_g, all_h = g[:, -1:], h[:, -1:]
                gain = g**2 / (h + ridge) + (all_g - g) ** 2 / (all_h - h + ridge) - all_g**2 / (all_h + ridge)
                gain = gain[:, : len(limits[j])]
                top = gain.argmax(axis=1)
                better = gain[np.arange(count), top] > best + 1e-9
                best[better] = gain[np.arange(count), top][better]
                feature[first + np.flatnonzero(better)] = j
                cut[first + np.flatnonzero(better)] = limits[j][top[better]]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > cut[node])
        leaf = node - inner
        value = -rate * np.bincount(leaf, slope, inner + 1) / (np.bincount(leaf, bend, inner + 1) + ridge)
        score += value[leaf]
        features.append(feature)
        cuts.append(cut)
        values.append(value)
    return Forest(base, np.array(features), np.array(cuts), np.array(values))
