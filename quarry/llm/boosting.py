"""Gradient-boosted trees in numpy: binary logistic loss, histogram splits, monotonic features.

A fitted model is four flat node arrays over all trees (feature, threshold, left child, value);
a right child stands next to its left. Scoring walks all rows through one tree at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 64


@dataclass
class Trees:
    feature: np.ndarray  # -1 at a leaf
    threshold: np.ndarray  # rows with a value <= threshold go left
    left: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of ``x``."""
        raw = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                f = self.feature[at]
                go = self.left[at] + (x[rows, np.maximum(f, 0)] > self.threshold[at])
                at = np.where(f >= 0, go, at)
            raw += self.value[at]
        return 1 / (1 + np.exp(-raw))


def fit(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, least: float = 10.0, ridge: float = 1.0) -> Trees:
    """``monotone``: per feature -1, 0 or 1; the score never moves against that sign."""
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(mean / (1 - mean)))
    raw = np.full(n, base)
    feature, threshold, left, value, roots = [], [], [], [], []

    def node() -> int:
        feature.append(-1)
        threshold.append(0.0)
        left.append(-1)
        value.append(0.0)
        return len(feature) - 1

    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        root = node()
        roots.append(root)
        open_ = [(root, np.arange(n), -np.inf, np.inf)]
        for level in range(depth + 1):
            following = []
            for at, rows, low, high in open_:
                gs, hs = g[rows].sum(), h[rows].sum()
                value[at] = rate * float(np.clip(-gs / (hs + ridge), low, high))
                if level == depth or len(rows) < 2 * least:
                    continue
                best = (1e-6, -1, -1, 0.0, 0.0)
                for j in range(m):
                    b = binned[rows, j]
                    size = len(edges[j]) + 1
                    gl = np.cumsum(np.bincount(b, g[rows], size))[:-1]
                    hl = np.cumsum(np.bincount(b, h[rows], size))[:-1]
                    nl = np.cumsum(np.bincount(b, minlength=size))[:-1]
                    vl, vr = -gl / (hl + ridge), -(gs - gl) / (hs - hl + ridge)
                    gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
                    gain[(nl < least) | (len(rows) - nl < least)] = 0
                    if monotone[j]:
                        gain[(vr - vl) * monotone[j] < 0] = 0
                    if len(gain) and gain[k := int(np.argmax(gain))] > best[0]:
                        best = (gain[k], j, k, vl[k], vr[k])
                if best[1] < 0:
                    continue
                _, j, k, vl, vr = best
                a, b = node(), node()
                feature[at], threshold[at], left[at] = j, float(edges[j][k]), a
                inside = binned[rows, j] <= k
                mid = (np.clip(vl, low, high) + np.clip(vr, low, high)) / 2
                for child, chosen, right in ((a, rows[inside], False), (b, rows[~inside], True)):
                    lo, hi = low, high
                    if monotone[j]:
                        if (monotone[j] > 0) == right:
                            lo = max(lo, mid)
                        else:
                            hi = min(hi, mid)
                    following.append((child, chosen, lo, hi))
            open_ = following
        tree = Trees(*(np.array(v) for v in (feature, threshold, left, value)), np.array([root]), depth, 0.0)
        at = np.full(n, root)
        for _ in range(depth):
            f = tree.feature[at]
            at = np.where(f >= 0, tree.left[at] + (x[np.arange(n), np.maximum(f, 0)] > tree.threshold[at]), at)
        raw += tree.value[at]
    return Trees(np.array(feature), np.array(threshold), np.array(left), np.array(value), np.array(roots), depth, base)
