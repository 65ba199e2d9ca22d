"""Gradient-boosted trees of fixed depth for small binary problems, with a calibrated output. Numpy only."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class BoostedTrees:
    """Trees of `depth` levels as heaps: node k has children 2k+1 and 2k+2."""

    rounds: int = 60
    depth: int = 3
    rate: float = 0.25
    l2: float = 2.0
    bins: int = 32
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    bias: float = 0.0
    scale: tuple[float, float] = (1.0, 0.0)

    def fit(self, x: np.ndarray, y: np.ndarray) -> "BoostedTrees":
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], axis=1)
        self.bias = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        score = np.full(len(y), self.bias)
        for _ in range(self.rounds):
            p = sigmoid(score)
            tree = self._tree(binned, cuts, y - p, p * (1 - p))
            self.trees.append(tree)
            score += self._apply(tree, x)
        return self

    def _tree(self, binned: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray):
        size = 2**self.depth - 1
        feature, cut, leaf = np.zeros(size, dtype=int), np.full(size, np.inf), np.zeros(2 * size + 1)
        at = np.zeros(len(g), dtype=int)
        for node in range(size):
            own = np.flatnonzero(at == node)
            best, base = 1e-3, g[own].sum() ** 2 / (h[own].sum() + self.l2)
            for f, c in enumerate(cuts):
                if len(own) < 8 or not len(c):
                    continue
                gs, hs = (np.cumsum(np.bincount(binned[own, f], weights=w[own], minlength=len(c) + 1)) for w in (g, h))
                gain = gs[:-1] ** 2 / (hs[:-1] + self.l2) + (gs[-1] - gs[:-1]) ** 2 / (hs[-1] - hs[:-1] + self.l2) - base
                if len(gain) and gain.max() > best:
                    best, feature[node], cut[node] = gain.max(), f, c[int(gain.argmax())]
            right = np.zeros(len(own), dtype=bool) if np.isinf(cut[node]) else binned[own, feature[node]] > np.searchsorted(cuts[feature[node]], cut[node])
            at[own] = 2 * node + 1 + right
        for k in range(size, 2 * size + 1):
            own = at == k
            leaf[k] = self.rate * g[own].sum() / (h[own].sum() + self.l2)
        return feature, cut, leaf

    def _apply(self, tree, x: np.ndarray) -> np.ndarray:
        feature, cut, leaf = tree
        at = np.zeros(len(x), dtype=int)
        for _ in range(self.depth):
            at = 2 * at + 1 + (x[np.arange(len(x)), feature[at]] > cut[at])
        return leaf[at]

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.bias + sum((self._apply(t, x) for t in self.trees), np.zeros(len(x)))

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> "BoostedTrees":
        """Platt scaling on rows that were not fitted, by Newton steps with smoothed targets."""
        s, (a, b) = self.raw(x), (1.0, 0.0)
        n1, n0 = y.sum(), (1 - y).sum()
        t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
        for _ in range(30):
            p = sigmoid(a * s + b)
            w, d = p * (1 - p) + 1e-9, t - p
            m = np.array([[(w * s * s).sum() + 1e-6, (w * s).sum()], [(w * s).sum(), w.sum() + 1e-6]])
            da, db = np.linalg.solve(m, [(d * s).sum(), d.sum()])
            a, b = a + da, b + db
        self.scale = (float(a), float(b))
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.scale[0] * self.raw(x) + self.scale[1])
