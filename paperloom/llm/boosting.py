"""Gradient-boosted trees for a binary label, on binned features."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Complete trees of one depth, fitted level by level to logistic loss."""

    def __init__(self, trees: int = 60, depth: int = 4, rate: float = 0.25, bins: int = 24, ridge: float = 2.0):
        self.trees, self.depth, self.rate, self.bins, self.ridge = trees, depth, rate, bins, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        edges = [np.unique(np.quantile(column, np.linspace(0, 1, self.bins + 1)[1:-1])) for column in x.T]
        binned = np.stack([np.searchsorted(e, column, "left") for e, column in zip(edges, x.T, strict=True)], 1)
        self.base = float(np.log(y.mean() / (1 - y.mean())))
        margin = np.full(len(y), self.base)
        inner = (1 << self.depth) - 1
        self.feature = np.zeros((self.trees, inner), np.int64)
        self.cut = np.full((self.trees, inner), np.inf)
        self.leaf = np.zeros((self.trees, 1 << self.depth))
        width = self.bins + 1
        for tree in range(self.trees):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, p * (1 - p)
            place = np.zeros(len(y), np.int64)
            for level in range(self.depth):
                count = 1 << level
                best, choice = np.full(count, 1e-6), [(-1, 0)] * count
                for f in range(x.shape[1]):
                    key = place * width + binned[:, f]
                    left_g = np.bincount(key, g, count * width).reshape(count, width).cumsum(1)
                    left_h = np.bincount(key, h, count * width).reshape(count, width).cumsum(1)
                    all_g, all_h = left_g[:, -1:], left_h[:, -1:]
                    score = lambda a, b: a * a / (b + self.ridge)
                    gain = score(left_g, left_h) + score(all_g - left_g, all_h - left_h) - score(all_g, all_h)
                    gain[:, len(edges[f]) :] = 0
                    at = gain.argmax(1)
                    for k in range(count):
                        if gain[k, at[k]] > best[k]:
                            best[k], choice[k] = gain[k, at[k]], (f, int(at[k]))
                goes = np.zeros(len(y), np.int64)
                for k, (f, at) in enumerate(choice):
                    if f >= 0:
                        self.feature[tree, count - 1 + k], self.cut[tree, count - 1 + k] = f, edges[f][at]
                        mine = place == k
                        goes[mine] = binned[mine, f] > at
                place = 2 * place + goes
            size = 1 << self.depth
            self.leaf[tree] = -self.rate * np.bincount(place, g, size) / (np.bincount(place, h, size) + self.ridge)
            margin += self.leaf[tree][place]
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        rows, total = np.arange(len(x)), np.full(len(x), self.base)
        for tree in range(self.trees):
            place = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = (1 << level) - 1 + place
                place = 2 * place + (x[rows, self.feature[tree, at]] > self.cut[tree, at])
            total += self.leaf[tree][place]
        return total
