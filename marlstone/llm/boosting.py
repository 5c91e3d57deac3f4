"""Gradient-boosted decision trees with the logistic loss, and isotonic calibration, in numpy."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Trees of a fixed depth on binned features; leaves take Newton steps."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.ridge = rounds, depth, rate, bins, ridge
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        x, y = np.asarray(x, np.float64), np.asarray(y, np.float64)
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1], method="lower")) for c in x.T]
        binned = np.column_stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)])
        share = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        z = np.full(len(y), self.base)
        n = self.bins + 1
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-z))
            g, h = y - p, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            feature, cut = np.zeros((1 << self.depth) - 1, np.int64), np.full((1 << self.depth) - 1, np.inf)
            for level in range(self.depth):
                width, offset = 1 << level, (1 << level) - 1
                best = np.zeros(width)
                for f in range(x.shape[1]):
                    if not len(cuts[f]):
                        continue
                    at = node * n + binned[:, f]
                    gs = np.bincount(at, g, width * n).reshape(width, n).cumsum(1)
                    hs = np.bincount(at, h, width * n).reshape(width, n).cumsum(1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    k = len(cuts[f])
                    gain = (gs[:, :k] ** 2 / (hs[:, :k] + self.ridge) + (gt - gs[:, :k]) ** 2 / (ht - hs[:, :k] + self.ridge)) - gt**2 / (ht + self.ridge)
                    top = gain.argmax(1)
                    value = gain[np.arange(width), top]
                    won = np.flatnonzero(value > best + 1e-9)
                    best[won], feature[offset + won], cut[offset + won] = value[won], f, cuts[f][top[won]]
                node = 2 * node + (x[np.arange(len(y)), feature[offset + node]] > cut[offset + node])
            leaf = np.bincount(node, g, 1 << self.depth) / (np.bincount(node, h, 1 << self.depth) + self.ridge) * self.rate
            self.trees.append((feature, cut, leaf))
            z += leaf[node]
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, np.float64)
        z, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = (1 << level) - 1 + node
                node = 2 * node + (x[rows, feature[at]] > cut[at])
            z += leaf[node]
        return z


class Isotonic:
    """A rising step function of scores, fitted by pooling neighbours that fall; a pool's share counts half a case of each label more, so none is 0 or 1."""

    def fit(self, z: np.ndarray, y: np.ndarray) -> Isotonic:
        order = np.argsort(z, kind="stable")
        pools: list[list[float]] = []
        for score, label in zip(z[order].tolist(), np.asarray(y, float)[order].tolist(), strict=True):
            pools.append([label, 1.0, score])
            while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
                s, n, top = pools.pop()
                pools[-1] = [pools[-1][0] + s, pools[-1][1] + n, top]
        self.tops = np.array([p[2] for p in pools])
        self.values = np.maximum.accumulate([(p[0] + 0.5) / (p[1] + 1) for p in pools])
        return self

    def __call__(self, z: np.ndarray) -> np.ndarray:
        return self.values[np.minimum(np.searchsorted(self.tops, z), len(self.tops) - 1)]
