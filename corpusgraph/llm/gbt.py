"""Gradient-boosted trees in numpy: histogram splits, logistic loss, monotonic constraints, flat node arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """All trees in one set of node arrays; a leaf points to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row: every tree is walked for all rows at once."""
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            out += self.value[at]
        return 1 / (1 + np.exp(-np.clip(out, -50, 50)))


def fit(x: np.ndarray, y: np.ndarray, monotone: list[int], trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, l2: float = 1.0, least: float = 2.0) -> Trees:
    """Boost trees on rows x (n, features) and labels y in {0, 1}.

    monotone[f] is 1 where the score must not fall as feature f grows, -1 where it must not rise, 0 where it is free. No rows
    or one class only: a constant.
    """
    n, m = x.shape
    rate_of_one = (y.sum() + 0.5) / (n + 1) if n else 0.5
    base = float(np.log(rate_of_one / (1 - rate_of_one)))
    nodes: list[list[float]] = []
    roots: list[int] = []
    if n and 0 < y.sum() < n:
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(m)]
        code = np.stack([np.searchsorted(cuts[f], x[:, f], "left") for f in range(m)], 1)
        raw = np.full(n, base)

        def grow(rows: np.ndarray, level: int, low: float, high: float) -> int:
            me, (g, h) = len(nodes), (grad[rows].sum(), hess[rows].sum())
            value = float(np.clip(-g / (h + l2), low, high))
            nodes.append([0, np.inf, me, me, value * rate])
            best = (1e-6, None)
            for f in range(m) if level < depth and len(rows) > 1 else ():
                size = len(cuts[f]) + 1
                gl = np.cumsum(np.bincount(code[rows, f], grad[rows], size))[:-1]
                hl = np.cumsum(np.bincount(code[rows, f], hess[rows], size))[:-1]
                vl, vr = np.clip(-gl / (hl + l2), low, high), np.clip(-(g - gl) / (h - hl + l2), low, high)
                gain = gl**2 / (hl + l2) + (g - gl) ** 2 / (h - hl + l2) - g**2 / (h + l2)
                gain[(hl < least * 0.1) | (h - hl < least * 0.1) | (monotone[f] * (vr - vl) < 0)] = 0
                if len(gain) and gain.max() > best[0]:
                    k = int(gain.argmax())
                    best = (float(gain[k]), (f, k, (vl[k] + vr[k]) / 2))
            if best[1]:
                f, k, mid = best[1]
                goes, way = code[rows, f] <= k, monotone[f]
                nodes[me][:2] = f, cuts[f][k]
                nodes[me][2] = grow(rows[goes], level + 1, mid if way < 0 else low, mid if way > 0 else high)
                nodes[me][3] = grow(rows[~goes], level + 1, mid if way > 0 else low, mid if way < 0 else high)
            return me

        for _ in range(trees):
            p = 1 / (1 + np.exp(-raw))
            grad, hess = p - y, np.maximum(p * (1 - p), 1e-6)
            roots.append(grow(np.arange(n), 0, -np.inf, np.inf))
            a = np.array(nodes)
            at = np.full(n, roots[-1])
            for _ in range(depth):
                at = np.where(x[np.arange(n), a[at, 0].astype(int)] <= a[at, 1], a[at, 2], a[at, 3]).astype(int)
            raw += a[at, 4]
    a = np.array(nodes).reshape(-1, 5)
    return Trees(a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int), a[:, 4], np.array(roots, int), depth, base)
