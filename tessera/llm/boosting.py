"""Gradient-boosted trees for two classes: Newton steps on logistic loss, full trees of one depth, splits between quantile bins."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    base: float
    feature: np.ndarray  # trees, inner nodes
    edge: np.ndarray
    leaf: np.ndarray  # trees, leaves

    def logit(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        inner = self.feature.shape[1]
        for f, e, leaf in zip(self.feature, self.edge, self.leaf):
            at = np.zeros(len(x), np.int64)
            while inner and len(at) and at[0] < inner:
                at = 2 * at + 1 + (x[rows, f[at]] > e[at])
            out += leaf[at - inner]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 5, rate: float = 0.2, bins: int = 32, ridge: float = 2.0, least: float = 4.0) -> Trees:
    n, d = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(d)]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1)
    offset = np.arange(d) * bins
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    score = np.full(n, base)
    inner = (1 << depth) - 1
    features, cuts, leaves = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first, width = (1 << level) - 1, 1 << level
            cell = ((at - first)[:, None] * (d * bins) + offset + binned).ravel()
            gs = np.bincount(cell, np.repeat(g, d), width * d * bins).reshape(width, d, bins).cumsum(2)
            hs = np.bincount(cell, np.repeat(h, d), width * d * bins).reshape(width, d, bins).cumsum(2)
            ga, ha = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + ridge) + (ga - gs) ** 2 / (ha - hs + ridge) - ga**2 / (ha + ridge)
            gain[(hs < least) | (ha - hs < least)] = -1
            best = gain.reshape(width, -1).argmax(1)
            for k, b in enumerate(best):
                f, c = divmod(int(b), bins)
                if gain[k, f, c] > 1e-6 and c < len(edges[f]):
                    features[t, first + k], cuts[t, first + k] = f, edges[f][c]
            at = 2 * at + 1 + (x[np.arange(n), features[t, at]] > cuts[t, at])
        leaf = at - inner
        leaves[t] = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + ridge)
        score += leaves[t, leaf]
    return Trees(base, features, cuts, leaves)
