"""Gradient-boosted trees for two classes: logistic loss, histogram splits, numpy only."""

from __future__ import annotations

import numpy as np

BINS = 16


class BoostedTrees:
    """Additive trees of fixed depth over binned features; ``logit`` is linear in the number of rows."""

    def __init__(self, rounds: int = 40, depth: int = 4, rate: float = 0.3, leaf_penalty: float = 1.0):
        self.rounds, self.depth, self.rate, self.leaf_penalty = rounds, depth, rate, leaf_penalty
        self.edges: np.ndarray | None = None  # features x (BINS - 1)
        self.feature: list[np.ndarray] = []  # per tree: feature and threshold of each inner node, breadth first
        self.threshold: list[np.ndarray] = []
        self.leaf: list[np.ndarray] = []
        self.start = 0.0

    def _binned(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(values.shape, dtype=np.uint8)
        for k in range(self.edges.shape[1]):
            out += values > self.edges[:, k]
        return out

    def fit(self, values: np.ndarray, target: np.ndarray) -> "BoostedTrees":
        values = values.astype(np.float32)
        shares = np.linspace(0, 1, BINS + 1)[1:-1]
        self.edges = np.quantile(values, shares, axis=0).T.astype(np.float32)
        # A rare 0/1 feature has no quantile between its values.
        flat = (values.min(0) >= 0) & (values.max(0) <= 1) & ((values == 0) | (values == 1)).all(0)
        self.edges[flat] = np.float32(np.inf)
        self.edges[flat, 0] = 0.5
        binned = self._binned(values)
        n, m = binned.shape
        flat_bins = binned.astype(np.int64) + np.arange(m) * BINS
        mean = np.clip(target.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(mean / (1 - mean)))
        score = np.full(n, self.start)
        for _ in range(self.rounds):
            chance = 1 / (1 + np.exp(-score))
            slope, curve = target - chance, np.maximum(chance * (1 - chance), 1e-6)
            node = np.zeros(n, dtype=np.int64)
            features, thresholds = [], []
            for level in range(self.depth):
                width = 2**level
                shape = (width, m, BINS)
                at = (node[:, None] * (m * BINS) + flat_bins).ravel()
                g = np.bincount(at, np.repeat(slope, m), width * m * BINS).reshape(shape).cumsum(2)
                h = np.bincount(at, np.repeat(curve, m), width * m * BINS).reshape(shape).cumsum(2)
                total_g, total_h = g[:, :, -1:], h[:, :, -1:]
                gain = g**2 / (h + self.leaf_penalty) + (total_g - g) ** 2 / (total_h - h + self.leaf_penalty)
                gain[:, :, -1] = -1
                best = gain.reshape(width, -1).argmax(1)
                features.append(best // BINS)
                thresholds.append(best % BINS)
                node = node * 2 + (binned[np.arange(n), features[-1][node]] > thresholds[-1][node])
            g = np.bincount(node, slope, 2**self.depth)
            h = np.bincount(node, curve, 2**self.depth)
            leaf = self.rate * g / (h + self.leaf_penalty)
            self.feature.append(np.concatenate(features))
            self.threshold.append(np.concatenate(thresholds))
            self.leaf.append(leaf)
            score += leaf[node]
        return self

    def logit(self, values: np.ndarray) -> np.ndarray:
        binned = self._binned(values.astype(np.float32))
        rows = np.arange(len(binned))
        score = np.full(len(binned), self.start)
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(binned), dtype=np.int64)
            for level in range(self.depth):
                at = node + 2**level - 1
                node = node * 2 + (binned[rows, feature[at]] > threshold[at])
            score += leaf[node]
        return score
