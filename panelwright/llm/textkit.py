"""Vectorised text primitives shared by the text operators.

Everything works on the UTF-8 buffer of an Arrow string column: a flat uint8
array plus row offsets.  No Python object is made per word, line or n-gram, so
the cost is a few numpy passes per byte.  Nulls read as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
CHUNK_BYTES = 1 << 20

# The six ASCII separators space, tab, line feed, vertical tab, form feed, return.
_SEPARATORS = np.zeros(256, dtype=bool)
_SEPARATORS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: ASCII letters and digits and every byte of a non-ASCII character.
_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = _ALNUM[128:] = True

_BASE = 0x9E3779B97F4A7C15
_CODES = np.random.Generator(np.random.PCG64(20240917)).integers(0, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_powers = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    global _powers
    if len(_powers) < n:
        grown = np.full(max(n, 2 * len(_powers)), U64(_BASE))
        grown[0] = 1
        with np.errstate(over="ignore"):
            _powers = np.multiply.accumulate(grown)
    return _powers[:n]


def power(n: int) -> np.uint64:
    return U64(pow(_BASE, n, 2**64))


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads polynomial sums over all bits."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column, null rows being empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("" if "string" in str(column.type) else b"")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64 if large else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(data: np.ndarray, offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole rows of about ``limit`` bytes."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def runs(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of True that do not cross rows."""
    n = len(member)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = member.copy()
    first[1:] &= ~member[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    first[cuts] = member[cuts]
    last = member.copy()
    last[:-1] &= ~member[1:]
    last[cuts - 1] = member[cuts - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


class Words:
    """Words of some rows: starts, ends, hashes (64 bits) and per-row offsets ``at``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, alnum: bool = False):
        self.data, self.offsets = data, offsets
        low = _LOWER[data]
        member = _ALNUM[data] if alnum else ~_SEPARATORS[data]
        self.starts, self.ends = runs(member, offsets)
        self.at = np.searchsorted(self.starts, offsets)
        lengths = self.ends - self.starts
        if len(self.starts):
            inside = np.arange(len(data), dtype=np.int64)
            origin = np.zeros(len(data), np.int64)
            origin[self.starts] = self.starts
            np.maximum.accumulate(origin, out=origin)
            inside -= origin
            top = int(lengths.max())
            value = _CODES[low] * powers(top + 1)[np.minimum(inside, top)]
            value[~member] = 0
            self.hashes = mix(np.add.reduceat(value, self.starts))
        else:
            self.hashes = np.zeros(0, np.uint64)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.at)

    def shingles(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, row) of all n-word runs; a row with fewer words, but some, has its whole sequence as one."""
        h, counts = self.hashes, self.counts
        row = np.repeat(np.arange(len(counts)), counts)
        if len(h) >= n:
            sh = np.zeros(len(h) - n + 1, np.uint64)
            for k in range(n):
                sh = sh * U64(_BASE) + h[k : len(h) - n + 1 + k]
            whole = row[: len(sh)] == row[n - 1 :]
            sh, of = mix(sh[whole]), row[: len(sh)][whole]
        else:
            sh, of = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for r in np.flatnonzero((counts > 0) & (counts < n)):
            v = U64(int(counts[r]))
            for x in h[self.at[r] : self.at[r + 1]]:
                v = U64((int(v) * _BASE + int(x)) & (2**64 - 1))
            sh, of = np.append(sh, mix(np.array([v], np.uint64))), np.append(of, r)
        return sh, of


def count_words(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Runs of non-separator bytes in each row."""
    out = np.zeros(len(offsets) - 1, np.int64)
    for i, j, part, at in chunks(data, offsets, 4 * CHUNK_BYTES):
        starts, _ = runs(~_SEPARATORS[part], at)
        out[i:j] = np.diff(np.searchsorted(starts, at))
    return out


def code_points(data: np.ndarray) -> np.ndarray:
    """True at every byte that begins a code point."""
    return (data & 0xC0) != 0x80


def gram_hashes(data: np.ndarray, n: int) -> np.ndarray:
    """Rolling 64-bit hash of each n-byte string, by doubling; not mixed."""
    total = len(data)
    if total < n:
        return np.zeros(0, np.uint64)
    have, size, done, out = _CODES[data], 1, 0, None
    while True:
        if n & size:
            piece = have[done : done + total - n + 1]
            out = piece.copy() if out is None else out * power(size) + piece
            done += size
        if done == n:
            return out
        have = have[:-size] * power(size) + have[size:]
        size *= 2


def row_hash(data: np.ndarray, offsets: np.ndarray, lower: bool = False, salt: int = 0) -> np.ndarray:
    """64-bit hash of each row's bytes and length."""
    codes = _CODES if not salt else mix(_CODES + U64(salt))
    out = np.zeros(len(offsets) - 1, np.uint64)
    for i, j, part, at in chunks(data, offsets):
        lengths = np.diff(at)
        if len(part):
            inside = np.arange(len(part), dtype=np.int64) - np.repeat(at[:-1], lengths)
            value = codes[_LOWER[part] if lower else part] * powers(int(lengths.max()) + 1)[inside]
            full = np.flatnonzero(lengths)
            out[i + full] = np.add.reduceat(value, at[:-1][full])
        out[i:j] = mix(out[i:j] + lengths.astype(np.uint64) * U64(0xD6E8FEB86659FD93))
    return out
