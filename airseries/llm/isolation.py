"""Isolation forest in numpy: fitted on the driver from a bounded sample, scored in batches."""

from __future__ import annotations

import numpy as np


def average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search in a binary search tree of n points."""
    n = np.asarray(n, dtype=float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1),
                    (n == 2).astype(float))


class IsolationForest:
    """Trees of random splits in flat arrays (feature -1: a leaf, whose path length is in ``value``)."""

    def __init__(self, feature, value, left, roots, norm):
        self.feature, self.value, self.left, self.roots, self.norm = feature, value, left, roots, norm

    @classmethod
    def fit(cls, sample: np.ndarray, trees: int = 200, size: int = 256, seed: int = 17) -> IsolationForest:
        """``sample`` rows are statistics; each tree takes ``size`` of them without replacement."""
        rng = np.random.default_rng(seed)
        size = min(size, len(sample))
        limit = int(np.ceil(np.log2(max(size, 2))))
        feature, value, left, roots = [], [], [], []

        def node() -> int:
            feature.append(-1)
            value.append(0.0)
            left.append(-1)
            return len(feature) - 1

        for _ in range(trees):
            roots.append(node())
            rows = sample[rng.choice(len(sample), size, replace=False)] if size else sample
            todo = [(roots[-1], rows, 0)]
            while todo:
                at, x, depth = todo.pop()
                varies = np.flatnonzero(x.max(axis=0) > x.min(axis=0)) if len(x) > 1 else []
                if depth >= limit or not len(varies):
                    value[at] = depth + float(average_path(len(x)))
                    continue
                k = int(rng.choice(varies))
                cut = float(rng.uniform(x[:, k].min(), x[:, k].max()))
                feature[at], value[at], left[at] = k, cut, node()
                node()
                below = x[:, k] <= cut
                todo += [(left[at], x[below], depth + 1), (left[at] + 1, x[~below], depth + 1)]
        return cls(np.array(feature), np.array(value), np.array(left), np.array(roots), float(average_path(size)) or 1.0)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly score in (0, 1]: 2 ** (-mean path length / average path)."""
        total = np.zeros(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            while (inner := np.flatnonzero(self.feature[at] >= 0)).size:
                node = at[inner]
                at[inner] = self.left[node] + (x[inner, self.feature[node]] > self.value[node])
            total += self.value[at]
        return np.exp2(-total / max(len(self.roots), 1) / self.norm)
