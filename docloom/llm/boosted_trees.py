"""Gradient-boosted trees for a binary label, by histograms, with monotonic constraints, in numpy.

All trees are complete binary trees of the same depth, flattened into node arrays, so a whole batch
descends one level with three array look-ups. A constraint of -1 (or +1) on a feature forbids every
split that would let the score rise (or fall) with it; bounds handed down to the children keep that
true across levels.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class FlatTrees:
    """feature and threshold of the inner nodes by heap index, value of the leaves; one row per tree."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += value[node - (2**self.depth - 1)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, monotone: list[int], trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, ridge: float = 1.0, least: float = 1.0) -> FlatTrees:
    """Newton boosting of the logistic loss. Without rows or with one class the result is constant."""
    n, width = x.shape if x.size else (0, len(monotone))
    inner, leaves = 2**depth - 1, 2**depth
    share = float(np.clip(y.mean() if n else 0.5, 1e-6, 1 - 1e-6))
    base = float(np.log(share / (1 - share)))
    feature, threshold, value = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    model = FlatTrees(feature, threshold, value, base, depth)
    if n == 0 or share in (1e-6, 1 - 1e-6):
        return model
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    coded = np.column_stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)])
    margin = np.full(n, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        gradient, hessian = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        low, high = np.full(2 * leaves - 1, -np.inf), np.full(2 * leaves - 1, np.inf)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            at = node - first
            total_g, total_h = np.bincount(at, gradient, count), np.bincount(at, hessian, count)
            best = np.zeros(count)
            split: list[tuple | None] = [None] * count
            for f in range(width):
                slots = len(edges[f]) + 1
                if slots < 2:
                    continue
                place = at * slots + coded[:, f]
                g = np.bincount(place, gradient, count * slots).reshape(count, slots).cumsum(1)[:, :-1]
                h = np.bincount(place, hessian, count * slots).reshape(count, slots).cumsum(1)[:, :-1]
                rest_g, rest_h = total_g[:, None] - g, total_h[:, None] - h
                lo, hi = low[first : first + count, None], high[first : first + count, None]
                left, right = np.clip(-g / (h + ridge), lo, hi), np.clip(-rest_g / (rest_h + ridge), lo, hi)
                whole = np.clip(-total_g / (total_h + ridge), lo[:, 0], hi[:, 0])[:, None]

                def gain(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
                    return -(a * w + 0.5 * (b + ridge) * w * w)

                won = gain(g, h, left) + gain(rest_g, rest_h, right) - gain(total_g[:, None], total_h[:, None], whole)
                bad = (h < least) | (rest_h < least)
                if monotone[f]:
                    bad |= monotone[f] * (right - left) < 0
                won[bad] = 0
                for k in np.flatnonzero(won.max(1) > best + 1e-9):
                    s = int(won[k].argmax())
                    best[k], split[k] = won[k, s], (f, s, left[k, s], right[k, s])
            for k, found in enumerate(split):
                i = first + k
                low[2 * i + 1 : 2 * i + 3], high[2 * i + 1 : 2 * i + 3] = low[i], high[i]
                if found:
                    f, s, left_w, right_w = found
                    feature[t, i], threshold[t, i] = f, edges[f][s]
                    middle = (left_w + right_w) / 2
                    if monotone[f] > 0:
                        high[2 * i + 1], low[2 * i + 2] = min(high[i], middle), max(low[i], middle)
                    elif monotone[f] < 0:
                        low[2 * i + 1], high[2 * i + 2] = max(low[i], middle), min(high[i], middle)
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > threshold[t, node])
        leaf = node - inner
        g, h = np.bincount(leaf, gradient, leaves), np.bincount(leaf, hessian, leaves)
        value[t] = rate * np.clip(-g / (h + ridge), low[inner:], high[inner:])
        margin += value[t, leaf]
    return model
