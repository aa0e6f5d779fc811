"""Gradient-boosted trees in numpy: histogram training, flat node arrays, monotone constraints."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """All trees in five flat arrays; a leaf points to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    bias: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row; missing values (NaN) go left."""
        node = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            right = x[rows, self.feature[node]] > self.threshold[node]
            node = np.where(right, self.right[node], self.left[node])
        return self.bias + self.value[node].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def _edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    return [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]


def train(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, l2: float = 1.0, least: float = 5.0) -> Forest:
    """Logistic boosting. ``monotone[j]`` is +1, -1 or 0: the margin must not fall, must not rise, or is free in feature j.

    A split on a constrained feature is taken only if its children's values are
    in order, and the middle between them bounds everything below either child.
    ``least`` is the smallest sum of second derivatives in a child.
    """
    n, k = x.shape
    edges = _edges(x, bins)
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    width = bins + 1
    p = min(max(y.mean(), 1e-3), 1 - 1e-3)
    bias = float(np.log(p / (1 - p)))
    margin = np.full(n, bias)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def leaf(v: float) -> int:
        i = len(feature)
        feature.append(0)
        threshold.append(np.inf)
        left.append(i)
        right.append(i)
        value.append(v)
        return i

    def grow(rows: np.ndarray, level: int, low: float, high: float) -> int:
        g, h = grad[rows], hess[rows]
        v = lambda a, b: np.clip(-a / (b + l2), low, high)
        own = float(v(g.sum(), h.sum()))
        me = leaf(own * rate)
        if level == depth or h.sum() < 2 * least:
            margin[rows] += own * rate
            return me
        gain = lambda a, b, w: -(a * w + 0.5 * (b + l2) * w * w)
        best = (1e-6, -1, 0, 0.0, 0.0)
        base = gain(g.sum(), h.sum(), own)
        for j in range(k):
            if not len(edges[j]):
                continue
            gs = np.bincount(binned[rows, j], g, width).cumsum()[: len(edges[j])]
            hs = np.bincount(binned[rows, j], h, width).cumsum()[: len(edges[j])]
            gr, hr = g.sum() - gs, h.sum() - hs
            wl, wr = v(gs, hs), v(gr, hr)
            good = (hs >= least) & (hr >= least) & (monotone[j] * (wr - wl) >= 0)
            won = np.where(good, gain(gs, hs, wl) + gain(gr, hr, wr) - base, -np.inf)
            b = int(won.argmax())
            if won[b] > best[0]:
                best = (float(won[b]), j, b, float(wl[b]), float(wr[b]))
        if best[1] < 0:
            margin[rows] += own * rate
            return me
        _, j, b, wl, wr = best
        goes = binned[rows, j] > b
        mid = (wl + wr) / 2
        bounds = {1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid)), 0: ((low, high), (low, high))}[int(monotone[j])]
        feature[me], threshold[me] = j, float(edges[j][b])
        left[me] = grow(rows[~goes], level + 1, *bounds[0])
        right[me] = grow(rows[goes], level + 1, *bounds[1])
        return me

    for _ in range(trees):
        prob = 1 / (1 + np.exp(-margin))
        grad, hess = prob - y, np.maximum(prob * (1 - prob), 1e-9)
        if hess.sum() < 2 * least:
            break
        roots.append(grow(np.arange(n), 0, -np.inf, np.inf))
    roots = roots or [leaf(0.0)]
    return Forest(np.array(feature, np.int32), np.array(threshold), np.array(left, np.int32), np.array(right, np.int32), np.array(value), np.array(roots, np.int32), depth, bias)
