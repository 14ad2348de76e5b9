"""Gradient-boosted regression trees for two classes: a small histogram learner in numpy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

BINS = 32


@dataclass
class Boosted:
    """Additive trees on logistic loss. ``trees``: per tree arrays of feature, threshold, left, right, value."""

    base: float = 0.0
    trees: list[tuple[np.ndarray, ...]] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log odds of the positive class for each row."""
        out = np.full(len(x), self.base)
        for feature, threshold, left, right, value in self.trees:
            at = np.zeros(len(x), np.int64)
            while True:
                inner = feature[at] >= 0
                if not inner.any():
                    break
                rows = np.flatnonzero(inner)
                node = at[rows]
                at[rows] = np.where(x[rows, feature[node]] <= threshold[node], left[node], right[node])
            out += value[at]
        return out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.2, ridge: float = 1.0) -> Boosted:
    """Boosted trees for labels 0 and 1; ties between splits go to the first feature and threshold."""
    share = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    model = Boosted(float(np.log(share / (1 - share))))
    if not len(y):
        return model
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1)
    margin = np.full(len(y), model.base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        gradient, weight = p - y, np.maximum(p * (1 - p), 1e-6)
        feature, threshold, left, right, value = [-1], [0.0], [0], [0], [0.0]
        leaf = np.zeros(len(y), np.int64)
        open_nodes = [(0, 0)]
        while open_nodes:
            node, level = open_nodes.pop(0)
            rows = np.flatnonzero(leaf == node)
            g, h = gradient[rows].sum(), weight[rows].sum()
            value[node] = -rate * g / (h + ridge)
            best, choice = 1e-6, None
            for j, c in enumerate(cuts if level < depth and len(rows) > 1 else []):
                gs = np.cumsum(np.bincount(binned[rows, j], gradient[rows], len(c) + 1))[:-1]
                hs = np.cumsum(np.bincount(binned[rows, j], weight[rows], len(c) + 1))[:-1]
                gain = gs**2 / (hs + ridge) + (g - gs) ** 2 / (h - hs + ridge) - g**2 / (h + ridge)
                if len(gain) and gain.max() > best:
                    best, choice = gain.max(), (j, int(gain.argmax()))
            if choice is None:
                continue
            j, k = choice
            feature[node], threshold[node], value[node] = j, float(cuts[j][k]), 0.0
            for side, goes in (("left", binned[rows, j] <= k), ("right", binned[rows, j] > k)):
                child = len(feature)
                (left if side == "left" else right)[node] = child
                for column, start in ((feature, -1), (threshold, 0.0), (left, 0), (right, 0), (value, 0.0)):
                    column.append(start)
                leaf[rows[goes]] = child
                open_nodes.append((child, level + 1))
        model.trees.append((np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(value)))
        margin += np.array(value)[leaf]
    return model
