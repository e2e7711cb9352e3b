"""Gradient-boosted trees in numpy: a small histogram trainer and flat node arrays.

The trees live in five arrays (feature, threshold, left, right, value), all trees one
after another, with ``roots`` naming where each starts. Scoring a block of rows walks
all of them level by level with array indexing, without a Python loop over rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    feature: np.ndarray  #: feature of a node; -1 in a leaf
    threshold: np.ndarray  #: rows with a value below it go left
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray  #: of a leaf, already times the learning rate
    roots: np.ndarray
    bias: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row of ``x``."""
        rows = np.arange(len(x))[:, None]
        node = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        for _ in range(self.depth):
            f = self.feature[node]
            inner = f >= 0
            low = x[rows, np.maximum(f, 0)] < self.threshold[node]
            node = np.where(inner, np.where(low, self.left[node], self.right[node]), node)
        return self.bias + self.value[node].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 48, ridge: float = 1.0, least: int = 5, monotone: dict[int, int] | None = None) -> Trees:
    """Logistic boosting with second-order splits on quantile bins.

    ``monotone`` maps a feature to +1 (the score may only rise with it) or -1 (only
    fall): splits against the sign are refused, and the children of an allowed one
    inherit the mid value as a bound, so that the whole tree keeps the order.
    Without rows, or with one class only, the result is a constant.
    """
    monotone = monotone or {}
    x, y = np.asarray(x, float), np.asarray(y, float)
    n, k = x.shape if x.ndim == 2 else (0, 0)
    p = (y.sum() + 0.5) / (n + 1.0)
    bias = float(np.log(p / (1 - p)))
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def node(f=-1, t=0.0, v=0.0) -> int:
        feature.append(f), threshold.append(t), left.append(-1), right.append(-1), value.append(v)
        return len(feature) - 1

    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:])) for j in range(k)] if n else []
    codes = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(cuts)]
    score = np.full(n, bias)

    def grow(at: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, lo: float, hi: float) -> int:
        sum_g, sum_h = g[at].sum(), h[at].sum()
        best = (1e-6, None)
        if level < depth and len(at) >= 2 * least:
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                b = codes[j][at]
                cg = np.cumsum(np.bincount(b, g[at], len(c) + 1))[:-1]
                ch = np.cumsum(np.bincount(b, h[at], len(c) + 1))[:-1]
                cn = np.cumsum(np.bincount(b, minlength=len(c) + 1))[:-1]
                wl, wr = -cg / (ch + ridge), -(sum_g - cg) / (sum_h - ch + ridge)
                gain = cg**2 / (ch + ridge) + (sum_g - cg) ** 2 / (sum_h - ch + ridge) - sum_g**2 / (sum_h + ridge)
                bad = (cn < least) | (len(at) - cn < least)
                if j in monotone:
                    bad |= (np.clip(wr, lo, hi) - np.clip(wl, lo, hi)) * monotone[j] < 0
                gain = np.where(bad, -np.inf, gain)
                if gain[i := int(np.argmax(gain))] > best[0]:
                    best = (gain[i], (j, i, float(np.clip(wl[i], lo, hi)), float(np.clip(wr[i], lo, hi))))
        if best[1] is None:
            return node(v=float(np.clip(-sum_g / (sum_h + ridge), lo, hi)) * rate)
        j, i, wl, wr = best[1]
        me, goes = node(j, float(cuts[j][i])), codes[j][at] <= i
        mid = (wl + wr) / 2
        l_box, r_box = {0: ((lo, hi), (lo, hi)), 1: ((lo, mid), (mid, hi)), -1: ((mid, hi), (lo, mid))}[monotone.get(j, 0)]
        left[me] = grow(at[goes], g, h, level + 1, *l_box)
        right[me] = grow(at[~goes], g, h, level + 1, *r_box)
        return me

    for _ in range(trees if n and 0 < y.sum() < n else 0):
        prob = 1 / (1 + np.exp(-score))
        roots.append(grow(np.arange(n), prob - y, np.maximum(prob * (1 - prob), 1e-6), 0, -8.0, 8.0))
        one = Trees(np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(value), np.array(roots[-1:]), 0.0, depth)
        score += one.margin(x)
    if not feature:
        roots.append(node())
    return Trees(np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(value), np.array(roots), bias, depth)
