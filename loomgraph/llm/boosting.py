"""Gradient-boosted regression trees on binned features, and isotonic calibration."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Trees:
    """Squared-error boosting with trees of fixed depth, fitted level by level on histograms."""

    rounds: int = 120
    depth: int = 4
    rate: float = 0.1
    bins: int = 32
    least: int = 8
    edges: list[np.ndarray] = field(default_factory=list)
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    base: float = 0.0

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], 1) if len(self.edges) else np.zeros((len(x), 0), np.int64)

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Trees":
        if not len(y):
            return self
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        b, (n, f) = self.binned(x), x.shape
        self.base, self.trees = float(y.mean()), []
        at = np.full(n, self.base)
        flat = b + np.arange(f) * self.bins
        for _ in range(self.rounds):
            rest, node = y - at, np.zeros(n, np.int64)
            feature, cut = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, self.bins, np.int64)
            for level in range(self.depth):
                width, first = 2**level, 2**level - 1
                local = node - first
                cells = (flat + (local * f * self.bins)[:, None]).ravel()
                shape = (width, f, self.bins)
                count = np.bincount(cells, minlength=width * f * self.bins).reshape(shape)
                total = np.bincount(cells, weights=np.repeat(rest, f), minlength=width * f * self.bins).reshape(shape)
                nl, sl = count.cumsum(2)[:, :, :-1], total.cumsum(2)[:, :, :-1]
                na, sa = count.sum(2, keepdims=True), total.sum(2, keepdims=True)
                nr, sr = na - nl, sa - sl
                gain = np.where((nl >= self.least) & (nr >= self.least), sl**2 / (nl + 1) + sr**2 / (nr + 1) - sa**2 / (na + 1), -1.0).reshape(width, -1)
                best = gain.argmax(1)
                for k in range(width):
                    if gain[k, best[k]] > 1e-9:
                        feature[first + k], cut[first + k] = divmod(int(best[k]), self.bins - 1)
                node = 2 * node + 1 + (b[np.arange(n), feature[node]] > cut[node])
            leaf = node - (2**self.depth - 1)
            value = np.bincount(leaf, weights=rest, minlength=2**self.depth) / (np.bincount(leaf, minlength=2**self.depth) + 1)
            at += self.rate * value[leaf]
            self.trees.append((feature, cut, self.rate * value))
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        out, b, rows = np.full(len(x), self.base), self.binned(x), np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (b[rows, feature[node]] > cut[node])
            out += value[node - (2**self.depth - 1)]
        return out


def isotonic(score: np.ndarray, y: np.ndarray, knots: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """The non-decreasing step fit of y on score (pool adjacent violators), as at most ``knots`` points to interpolate."""
    order = np.argsort(score, kind="stable")
    level: list[list[float]] = []
    for s, v in zip(score[order], y[order]):
        level.append([float(v), 1.0, float(s)])
        while len(level) > 1 and level[-2][0] >= level[-1][0]:
            v2, n2, s2 = level.pop()
            v1, n1, s1 = level[-1]
            level[-1] = [(v1 * n1 + v2 * n2) / (n1 + n2), n1 + n2, (s1 * n1 + s2 * n2) / (n1 + n2)]
    x, v = np.array([p[2] for p in level]), np.array([p[0] for p in level])
    keep = np.unique(np.linspace(0, len(x) - 1, min(len(x), knots)).astype(int)) if len(x) else np.zeros(0, int)
    return x[keep], v[keep]
