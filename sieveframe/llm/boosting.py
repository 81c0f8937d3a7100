"""Gradient-boosted trees in numpy: logistic loss, histogram splits, monotonic constraints, flattened nodes.

Training is meant for bounded samples on the driver; the model is a handful of arrays (a few kB) that travels
inside a function and scores whole batches at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Forest:
    """All trees' nodes in shared arrays; a leaf has feature -1 and points to itself."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    cut: np.ndarray  # rows with value <= cut go left
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row: one gather per level for all rows and trees."""
        out = np.full(len(x), self.base)
        if not len(self.roots):
            return out
        for at in range(0, len(x), 4096):
            part = x[at : at + 4096]
            node = np.broadcast_to(self.roots, (len(part), len(self.roots))).copy()
            row = np.arange(len(part))[:, None]
            for _ in range(self.depth):
                f = self.feature[node]
                go = part[row, np.maximum(f, 0)] <= self.cut[node]
                node = np.where(f < 0, node, np.where(go, self.left[node], self.right[node]))
            out[at : at + 4096] += self.value[node].sum(axis=1)
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, monotone: tuple[int, ...] = (), trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, least: int = 5, l2: float = 1.0) -> Forest:
    """monotone: per feature 1 (score never falls as it grows), -1 (never rises) or 0.

    Constraints hold by refusing splits whose leaves are out of order and by bounding what lies below a split
    by the middle of its two values.
    """
    x, y = np.asarray(x, float), np.asarray(y, float)
    n, m = x.shape if x.ndim == 2 else (0, 0)
    share = min(max((y.sum() + 0.5) / (n + 1), 1e-6), 1 - 1e-6)
    base = float(np.log(share / (1 - share)))
    sign = np.array(monotone or [0] * m)
    nodes: list[list[float]] = []  # feature, cut, left, right, value
    roots: list[int] = []
    if n and 0 < y.sum() < n:
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(m)]
        code = np.stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(m)], axis=1)
        f = np.full(n, base)

        def leaf(g: float, h: float, low: float, high: float) -> float:
            return float(np.clip(g / (h + l2), low, high))

        def grow(rows: np.ndarray, level: int, low: float, high: float) -> int:
            gs, hs = grad[rows], hess[rows]
            g, h = gs.sum(), hs.sum()
            me = len(nodes)
            nodes.append([-1, 0.0, me, me, rate * leaf(g, h, low, high)])
            if level == depth or len(rows) < 2 * least:
                return me
            best = (1e-9, -1, -1, 0.0, 0.0)
            for j in range(m):
                k = len(edges[j])
                if not k:
                    continue
                c = code[rows, j]
                gl = np.cumsum(np.bincount(c, gs, k + 1))[:-1]
                hl = np.cumsum(np.bincount(c, hs, k + 1))[:-1]
                nl = np.cumsum(np.bincount(c, minlength=k + 1))[:-1]
                a, b = np.clip(gl / (hl + l2), low, high), np.clip((g - gl) / (h - hl + l2), low, high)
                gain = gl * a - 0.5 * (hl + l2) * a * a + (g - gl) * b - 0.5 * (h - hl + l2) * b * b
                w = leaf(g, h, low, high)
                gain -= g * w - 0.5 * (h + l2) * w * w
                gain[(nl < least) | (len(rows) - nl < least) | (sign[j] * (b - a) < 0)] = -1
                at = int(np.argmax(gain))
                if gain[at] > best[0]:
                    best = (float(gain[at]), j, at, float(a[at]), float(b[at]))
            _, j, at, a, b = best
            if j < 0:
                return me
            go = code[rows, j] <= at
            mid = (a + b) / 2
            bounds = {0: (low, high, low, high), 1: (low, mid, mid, high), -1: (mid, high, low, mid)}[int(sign[j])]
            left = grow(rows[go], level + 1, *bounds[:2])
            right = grow(rows[~go], level + 1, *bounds[2:])
            nodes[me] = [j, float(edges[j][at]), left, right, 0.0]
            return me

        for _ in range(trees):
            p = 1 / (1 + np.exp(-f))
            grad, hess = y - p, p * (1 - p)
            before = len(nodes)
            roots.append(grow(np.arange(n), 0, -8.0, 8.0))
            t = np.array(nodes[before:])
            node = np.zeros(n, int)
            for _ in range(depth):
                k = t[node, 0].astype(int)
                go = x[np.arange(n), np.maximum(k, 0)] <= t[node, 1]
                node = np.where(k < 0, node, np.where(go, t[node, 2], t[node, 3]).astype(int) - before)
            f += t[node, 4]
    a = np.array(nodes) if nodes else np.empty((0, 5))
    return Forest(base, np.array(roots, int), a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int), a[:, 4], depth)


def threshold_for_recall(score: np.ndarray, y: np.ndarray, recall: float) -> float:
    """Highest threshold at which that share of the positives passes."""
    pos = np.sort(score[y == 1])
    return float(pos[int(np.floor((1 - recall) * len(pos)))]) if len(pos) else 0.5


def threshold_for_precision(score: np.ndarray, y: np.ndarray, precision: float) -> float:
    """Lowest threshold above which that share of what passes is positive; above 1 if none is."""
    order = np.argsort(-score, kind="stable")
    hit = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    ends = np.append(score[order][1:] < score[order][:-1], True) if len(y) else np.empty(0, bool)
    good = np.nonzero((hit >= precision) & ends)[0]
    return float(score[order][good[-1]]) if len(good) else 1.1
