"""Gradient-boosted oblivious trees for a yes/no label, in numpy."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Each tree asks the same question of every row at a level, so a leaf is a number made of answers."""

    def __init__(self, trees: int = 80, depth: int = 4, rate: float = 0.2, bins: int = 24, ridge: float = 1.0):
        self.n, self.depth, self.rate, self.bins, self.ridge = trees, depth, rate, bins, ridge
        self.trees: list[tuple[list[tuple[int, float]], np.ndarray]] = []
        self.start, self.scale, self.shift = 0.0, 1.0, 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = [np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)]  # bin <= k: value <= edge k
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(p / (1 - p)))
        f = np.full(len(y), self.start)
        for _ in range(self.n):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            leaf, asked = np.zeros(len(y), np.int64), []
            for level in range(self.depth):
                best = (-1.0, 0, 0)
                for j, (e, b) in enumerate(zip(edges, binned)):
                    k = len(e) + 1
                    if k < 2:
                        continue
                    at = leaf * k + b
                    sums = [np.bincount(at, v, k << level).reshape(-1, k).cumsum(1) for v in (g, h)]
                    (gl, hl), (ga, ha) = [s[:, :-1] for s in sums], [s[:, -1:] for s in sums]
                    gain = (gl**2 / (hl + self.ridge) + (ga - gl) ** 2 / (ha - hl + self.ridge)).sum(0)
                    if gain[i := int(gain.argmax())] > best[0]:
                        best = (float(gain[i]), j, i)
                _, j, i = best
                asked.append((j, float(edges[j][i])))
                leaf = leaf * 2 + (binned[j] > i)
            value = self.rate * np.bincount(leaf, g, 1 << self.depth) / (np.bincount(leaf, h, 1 << self.depth) + self.ridge)
            self.trees.append((asked, value))
            f += value[leaf]
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.start)
        for asked, value in self.trees:
            leaf = np.zeros(len(x), np.int64)
            for j, edge in asked:
                leaf = leaf * 2 + (x[:, j] > edge)
            f += value[leaf]
        return f

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        """Fits probability = sigmoid(scale * margin + shift) on rows that the trees have not seen."""
        m = self.margin(x)
        a, b = 1.0, 0.0
        t = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
        for _ in range(50):
            p = 1 / (1 + np.exp(-(a * m + b)))
            d, w = p - t, p * (1 - p) + 1e-9
            hess = np.array([[(w * m * m).sum() + 1e-3, (w * m).sum()], [(w * m).sum(), w.sum() + 1e-3]])
            step = np.linalg.solve(hess, [(d * m).sum(), d.sum()])
            a, b = a - step[0], b - step[1]
        self.scale, self.shift = float(a), float(b)
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.margin(x) + self.shift, -50, 50)))
