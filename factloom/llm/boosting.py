"""Gradient-boosted trees of depth two for a bounded sample of labelled rows, on numpy alone."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Logistic loss, quantile thresholds, Newton leaves; fitting is deterministic."""

    def __init__(self, rounds: int = 40, rate: float = 0.3, bins: int = 16) -> None:
        self.rounds, self.rate, self.bins = rounds, rate, bins
        self.trees: list[tuple] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        x, y = np.asarray(x, float), np.asarray(y, float)
        share = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            root = self._split(x, g, h, np.ones(len(y), bool), cuts)
            if root is None:
                break
            left = x[:, root[0]] <= root[1]
            tree = [root]
            for side in (left, ~left):
                tree.append((self._split(x, g, h, side, cuts), self._leaf(g[side], h[side])))
            self.trees.append(tuple(tree))
            score += self._tree(x, self.trees[-1])
        return self

    def _leaf(self, g: np.ndarray, h: np.ndarray) -> float:
        return float(self.rate * g.sum() / (h.sum() + 1.0))

    def _split(self, x, g, h, rows, cuts):
        """Feature, threshold and the leaves of both sides of the best split of some rows."""
        best, found = 1e-9, None
        gs, hs = g[rows], h[rows]
        whole = gs.sum() ** 2 / (hs.sum() + 1.0)
        for j, at in enumerate(cuts):
            col = x[rows, j]
            for c in at:
                low = col <= c
                a, b = gs[low].sum(), hs[low].sum()
                gain = a * a / (b + 1.0) + (gs.sum() - a) ** 2 / (hs.sum() - b + 1.0) - whole
                if gain > best:
                    best, found = gain, (j, float(c), self._leaf(gs[low], hs[low]), self._leaf(gs[~low], hs[~low]))
        return found

    def _tree(self, x: np.ndarray, tree: tuple) -> np.ndarray:
        (j, c, _, _), *sides = tree
        left, out = x[:, j] <= c, np.zeros(len(x))
        for rows, (split, leaf) in zip((left, ~left), sides):
            out[rows] = leaf if split is None else np.where(x[rows, split[0]] <= split[1], split[2], split[3])
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, float)
        score = np.full(len(x), self.base)
        for tree in self.trees:
            score += self._tree(x, tree)
        return 1 / (1 + np.exp(-score))
