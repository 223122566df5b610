"""Supervised split points from class counts at candidate cuts (a bounded table, whatever the rows)."""

from __future__ import annotations

import math

import numpy as np


def entropy(counts: np.ndarray) -> np.ndarray:
    """Bits of each row of class counts; 0 for an empty row."""
    total = counts.sum(-1, keepdims=True)
    p = counts / np.maximum(total, 1e-300)
    return -(p * np.log2(np.where(p > 0, p, 1))).sum(-1)


def _best_cut(counts: np.ndarray, impurity) -> tuple[float, int]:
    """(gain, k): splitting rows :k from k: lowers the weighted impurity most; smallest k of equals."""
    left = counts.cumsum(0)[:-1]
    right = counts.sum(0) - left
    n = counts.sum()
    after = (left.sum(1) * impurity(left) + right.sum(1) * impurity(right)) / n
    k = int(np.argmin(np.round(after, 12)))
    return float(impurity(counts.sum(0)[None])[0] - after[k]), k + 1


def mdlp(values: np.ndarray, counts: np.ndarray) -> list[float]:
    """Fayyad and Irani's cuts (1993): split while the gain pays for describing the split; cuts lie between values.

    ``values`` ascend; counts[i, c] is the rows of class c at value i.
    """
    out: list[float] = []
    stack = [(0, len(values))]
    while stack:
        lo, hi = stack.pop()
        part = counts[lo:hi]
        if hi - lo < 2:
            continue
        gain, k = _best_cut(part, entropy)
        n = part.sum()
        halves = [part[:k].sum(0), part[k:].sum(0)]
        whole = part.sum(0)
        kinds = [int((c > 0).sum()) for c in (whole, *halves)]
        ents = [float(entropy(c[None])[0]) for c in (whole, *halves)]
        price = math.log2(3 ** kinds[0] - 2) - (kinds[0] * ents[0] - kinds[1] * ents[1] - kinds[2] * ents[2])
        if n < 2 or gain <= (math.log2(n - 1) + price) / n:
            continue
        out.append((values[lo + k - 1] + values[lo + k]) / 2)
        stack += [(lo, lo + k), (lo + k, hi)]
    return sorted(float(v) for v in out)


def tree_cuts(values: np.ndarray, counts: np.ndarray, depth: int = 2, smallest: int = 1) -> list[float]:
    """Thresholds of a Gini decision tree on one column, to a depth, no leaf below ``smallest`` rows."""

    def gini(c: np.ndarray) -> np.ndarray:
        total = np.maximum(c.sum(-1, keepdims=True), 1e-300)
        return 1 - ((c / total) ** 2).sum(-1)

    out: list[float] = []
    level = [(0, len(values))]
    for _ in range(depth):
        following = []
        for lo, hi in level:
            if hi - lo < 2:
                continue
            gain, k = _best_cut(counts[lo:hi], gini)
            if gain <= 1e-12 or min(counts[lo : lo + k].sum(), counts[lo + k : hi].sum()) < smallest:
                continue
            out.append((values[lo + k - 1] + values[lo + k]) / 2)
            following += [(lo, lo + k), (lo + k, hi)]
        level = following
    return sorted(float(v) for v in out)
