"""Gradient-boosted trees on a small labelled sample, fitted on the driver with numpy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Boosted:
    """Logistic boosting of trees of fixed depth; ``rows`` bounds the sample it may fit on."""

    trees: int = 90
    depth: int = 4
    rate: float = 0.2
    least: float = 3.0
    share: float = 0.4  # of the cuts, those a tree may use, drawn anew for each
    seed: int = 1
    rows: int = 60_000
    base: float = 0.0
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        if len(x) > self.rows:
            raise ValueError(f"the labelled sample is bounded by {self.rows} rows")
        share = float(np.clip(y.mean(), 0.001, 0.999))
        self.base = float(np.log(share / (1 - share)))
        score = np.full(len(x), self.base)
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, 17)[1:-1])) for c in x.T]
        cuts = [c[c < v.max()] if len(c) else c for c, v in zip(cuts, x.T, strict=True)]
        where = [(f, float(c)) for f, own in enumerate(cuts) for c in own]
        if not where:
            return self
        below = np.stack([x[:, f] <= c for f, c in where], axis=1).astype(np.float32)
        r = np.random.default_rng(self.seed)
        for _ in range(self.trees):
            own = np.sort(r.choice(len(where), max(1, int(self.share * len(where))), replace=False))
            p = 1 / (1 + np.exp(-score))
            part = self._grow(x, below[:, own], [where[k] for k in own], y - p, p * (1 - p))
            self.parts.append(part)
            score += self._tree(x, part)
        return self

    def _grow(self, x, below, where, gradient, weight):
        """All nodes of a level at once: one matrix product gives the sums on either side of every cut."""
        size = 2**self.depth
        feature, cut = np.zeros(size - 1, dtype=np.int64), np.full(size - 1, np.inf)
        node = np.zeros(len(x), dtype=np.int64)
        for level in range(self.depth):
            first, count = 2**level - 1, 2**level
            at = node - first
            g, h = (np.zeros((count, len(x)), dtype=np.float32) for _ in range(2))
            g[at, np.arange(len(x))], h[at, np.arange(len(x))] = gradient, weight
            lg, lh = g @ below, h @ below
            tg, th = g.sum(axis=1, keepdims=True), h.sum(axis=1, keepdims=True)
            gain = lg**2 / (lh + self.least) + (tg - lg) ** 2 / (th - lh + self.least) - tg**2 / (th + self.least)
            best = gain.argmax(axis=1)
            for k in range(count):
                if gain[k, best[k]] > 1e-3:
                    feature[first + k], cut[first + k] = where[best[k]]
            node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > cut[node])
        leaf = node - (size - 1)
        g, h = np.bincount(leaf, gradient, size), np.bincount(leaf, weight, size)
        return feature, cut, self.rate * g / (h + self.least)

    def _tree(self, x, part):
        feature, cut, value = part
        node = np.zeros(len(x), dtype=np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > cut[node])
        return value[node - len(cut)]

    def probability(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.base)
        for part in self.parts:
            score += self._tree(x, part)
        return 1 / (1 + np.exp(-score))
