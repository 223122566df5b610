"""Blockwise suffix sorting with a difference cover, on rows of bytes.

A block is a byte matrix, one excerpt of text in each row, zeros around it.
Suffixes of a block are sorted one bucket at a time, a bucket being the suffixes
that start in one column.  Ties beyond the first ``PERIOD`` bytes are resolved
by ranks of the cover sample: columns whose index modulo PERIOD is in a
difference cover.  Sample ranks are computed once for the block, from right to
left, each from the next PERIOD bytes and the rank PERIOD columns on, so sorting
a bucket never looks at more than PERIOD bytes and one rank for each suffix and
needs memory in proportion to the block's rows alone.
"""

from __future__ import annotations

import numpy as np

PERIOD = 8


def difference_cover(period: int) -> list[int]:
    """A small set of residues whose pairwise differences give every residue: greedy, deterministic."""
    cover, seen = [0], {0}
    while len(seen) < period:
        best = max(range(1, period), key=lambda c: (len({(c - x) % period for x in cover} | {(x - c) % period for x in cover} | seen) if c not in cover else -1, -c))
        seen |= {(best - x) % period for x in cover} | {(x - best) % period for x in cover}
        cover.append(best)
    return sorted(cover)


def shift_to(cover: list[int], period: int, column: int, other: int | None = None) -> int:
    """Least l such that column + l (and other + l) are sample positions."""
    other = column if other is None else other
    return next(x for x in range(period) if (column + x) % period in cover and (other + x) % period in cover)


def _words(block: np.ndarray, column: int) -> np.ndarray:
    """The PERIOD bytes from ``column`` on as big-endian numbers."""
    return np.ascontiguousarray(block[:, column : column + PERIOD]).view(">u8").ravel().astype(np.uint64)


def _dense(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Dense ranks of pairs."""
    order = np.lexsort((second, first))
    a, b = first[order], second[order]
    step = np.zeros(len(a), np.uint32)
    step[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    rank = np.empty(len(a), np.uint32)
    rank[order] = np.cumsum(step, dtype=np.uint32)
    return rank


class Block:
    """``block``: uint8 matrix whose last 2 * PERIOD columns are zeros."""

    def __init__(self, block: np.ndarray):
        self.block = block
        self.cover = difference_cover(PERIOD)
        self.columns = block.shape[1] - 2 * PERIOD
        none = np.zeros(len(block), np.uint32)
        self.rank: dict[int, np.ndarray] = {}
        for c in range(self.columns + PERIOD, -1, -1):
            if c % PERIOD in self.cover:
                self.rank[c] = none if c >= self.columns else _dense(_words(block, c), self.rank[c + PERIOD])

    def sort_bucket(self, column: int, rows: np.ndarray) -> np.ndarray:
        """``rows`` in the order of their suffixes from ``column``."""
        step = shift_to(self.cover, PERIOD, column)
        return rows[np.lexsort((self.rank[column + step][rows], _words(self.block, column)[rows]))]

    def equal_to_last(self, column: int, rows: np.ndarray, depth: int) -> np.ndarray:
        """Of sorted rows: whether the suffix shares ``depth`` bytes with the one before it."""
        part = self.block[:, column : column + depth][rows]
        same = np.zeros(len(rows), bool)
        same[1:] = (part[1:] == part[:-1]).all(axis=1)
        return same
