"""Benchmark decontamination: word-pair seeds, a word-count bound, then Smith-Waterman alignment.

1. All of an item's pairs of neighbouring words are its seeds.  A copy without one
   has a change at every place between two words that it keeps, and with m of
   them scores (m + 1) / 2 at most.
2. Each seed met in a document proposes a window around where the item would
   stand, wide enough for any alignment through the seed that can be reported;
   windows of neighbouring diagonals merge.
3. A window has no higher score than it has words in common with the item, each
   counted as often as both have it; windows that this keeps below the threshold
   are left out.
4. A local alignment of words (match 1, mismatch and gap -1/2) scores the others.
   A pair is reported when its score is at least THRESHOLD of the item's words,
   or ENOUGH words of an item of any length, and LEAST words.

Items travel to the executors in blocks of bounded size; no text is shuffled.

Defined results: null and empty texts and items without words match nothing; items
under MIN_WORDS words are no passages and match documents that consist of just
their words; repeated documents are each reported; repeated
items (same id) count as the item with the least text; equal items with different
ids are each reported.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .support import table, text_bytes, tidied_batches

SEED_WORDS = 2
MIN_WORDS = 5
THRESHOLD = 0.5
LEAST = 8
ENOUGH = 25
GAP = 0.5
MISMATCH = 0.5
BLOCK_BYTES = 4 << 20
_PAD = tk.U64(0)
_CELLS = 1 << 18


class Items:
    """Word hashes of benchmark items and an index of their n-grams."""

    def __init__(self, ids: list[int], texts: list[str]):
        data = np.frombuffer("".join(texts).encode(), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])]).astype(np.int64)
        w = tk.Words(data, offsets, alnum=True)
        # Passages first, then short items, found by their whole word sequence.
        keep = np.flatnonzero(w.counts >= MIN_WORDS)
        few = np.flatnonzero((w.counts > 0) & (w.counts < MIN_WORDS))
        self.ids = np.array(ids, np.int64)[np.r_[keep, few]]
        self.words = [w.hashes[w.at[k] : w.at[k + 1]] for k in keep]
        self.short: dict[bytes, list[int]] = {}
        for k, place in enumerate(few, len(keep)):
            self.short.setdefault(w.hashes[w.at[place] : w.at[place + 1]].tobytes(), []).append(k)
        grams, item, place = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k, words in enumerate(self.words):
            g = ngrams(words)
            grams.append(g), item.append(np.full(len(g), k)), place.append(np.arange(len(g)))
        grams, item, place = np.concatenate(grams), np.concatenate(item), np.concatenate(place)
        self.grams, of = np.unique(grams, return_inverse=True)
        # Postings (item, place) of each n-gram.
        order = np.argsort(of, kind="stable")
        self.post_item, self.post_place = item[order], place[order]
        self.post = np.searchsorted(of[order], np.arange(len(self.grams) + 1))
        self.table = np.zeros(1 << 18, bool)
        self.table[(self.grams >> tk.U64(46)).astype(np.int64)] = True
        self.vocabulary, of = np.unique(np.concatenate([np.zeros(0, np.uint64), *self.words]), return_inverse=True)
        self.word_ids = np.split(of, np.cumsum([len(x) for x in self.words])[:-1]) if self.words else []

    def known(self, hashes: np.ndarray) -> np.ndarray:
        """Vocabulary index of each word; of words that no item has, the vocabulary's size."""
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at, len(self.vocabulary))

    def find(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, n-gram indices) of those that the index has."""
        maybe = np.flatnonzero(self.table[(grams >> tk.U64(46)).astype(np.int64)])
        if not len(self.grams):
            return maybe[:0], maybe[:0]
        at = np.minimum(np.searchsorted(self.grams, grams[maybe]), len(self.grams) - 1)
        hit = self.grams[at] == grams[maybe]
        return maybe[hit], at[hit]


def ngrams(words: np.ndarray, n: int = SEED_WORDS) -> np.ndarray:
    if len(words) < n:
        return np.zeros(0, np.uint64)
    g = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        g = g * tk.U64(tk._BASE) + words[k : len(g) + k]
    return tk.mix(g)


def align(item: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(best local score, end place) of an item's words against each row of ``windows``.

    A row of the score matrix at a time: a run of gaps along the row is a running
    maximum of scores raised by the gaps that they save.
    """
    n, width = windows.shape
    h = np.zeros((n, width + 1))
    best, end = np.zeros(n), np.zeros(n, np.int64)
    rise = GAP * np.arange(width + 1)
    for word in item:
        step = np.where(windows == word, 1.0, -MISMATCH)
        new = np.zeros_like(h)
        np.maximum(h[:, :-1] + step, h[:, 1:] - GAP, out=new[:, 1:])
        np.maximum(new, 0, out=new)
        h = np.maximum.accumulate(new + rise, axis=1) - rise
        top = h.argmax(1)
        value = h[np.arange(n), top]
        better = value > best
        best[better], end[better] = value[better], top[better]
    return best, end


def _windows(items: Items, w: tk.Words, grams: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, item, first word, end word) of merged windows; words numbered in the chunk."""
    place, g = items.find(grams)
    lo, hi = items.post[g], items.post[g + 1]
    held = hi - lo
    p = np.repeat(place, held)
    ends = np.cumsum(held)
    k = np.repeat(lo - (ends - held), held) + np.arange(ends[-1] if len(ends) else 0)
    item, start = items.post_item[k], p - items.post_place[k]
    r = row[p]
    order = np.lexsort((start, item, r))
    r, item, start = r[order], item[order], start[order]
    size = np.array([len(x) for x in items.words], np.int64)[item]
    # A reported alignment leaves out no more words than the item has, and inserts 2 * (size - least score) at most.
    least = np.array([least_score(len(x)) for x in items.words])[item]
    slack = np.maximum(size, np.floor(2 * (size - least)).astype(np.int64))
    new = np.r_[True, (r[1:] != r[:-1]) | (item[1:] != item[:-1]) | (start[1:] - start[:-1] > slack[1:])] if len(r) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    stop = np.r_[at[1:], len(r)] - 1
    r, item = r[at], item[at]
    first = np.maximum(start[at] - slack[at], w.at[r]) if len(at) else at
    last = np.minimum(start[stop] + size[stop] + slack[stop], w.at[r + 1]) if len(at) else at
    return r, item, first, last


def _common(local: np.ndarray, held: np.ndarray, ids: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Words that each window and the item have in common; ``local`` numbers the item's words from 1, ``held`` counts them."""
    n = len(held) + 1
    out = np.zeros(len(first), np.int64)
    ends = np.cumsum(last - first)
    i = 0
    while i < len(first):
        # As many windows at a time as bound the memory.
        before = ends[i - 1] if i else 0
        j = min(max(i + 1, int(np.searchsorted(ends, before + _CELLS, "right"))), i + max(1, _CELLS // n))
        length = (last - first)[i:j]
        at = np.repeat(first[i:j] - (ends[i:j] - length - before), length) + np.arange(ends[j - 1] - before)
        met = local[ids[at]]
        hit = np.flatnonzero(met)
        seen = np.bincount(np.repeat(np.arange(j - i), length)[hit] * n + met[hit], minlength=(j - i) * n).reshape(j - i, n)
        out[i:j] = np.minimum(seen[:, 1:], held).sum(1)
        i = j
    return out


def least_score(words: int) -> float:
    """The least reported score of an item of so many words."""
    return max(min(THRESHOLD * words, ENOUGH), min(words, LEAST))


def matches(items: Items, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, float, int, int]]:
    """(row, item index, score, first word, end word) of the best alignment of each reported pair."""
    w = tk.Words(data, offsets, alnum=True)
    for r in np.flatnonzero((w.counts > 0) & (w.counts < MIN_WORDS)) if items.short else ():
        for k in items.short.get(w.hashes[w.at[r] : w.at[r + 1]].tobytes(), ()):
            yield int(r), k, 1.0, 0, int(w.counts[r])
    if len(w.hashes) < SEED_WORDS or not items.words:
        return
    row = np.repeat(np.arange(len(offsets) - 1), w.counts)
    grams = ngrams(w.hashes)
    own = np.flatnonzero(row[: len(grams)] == row[SEED_WORDS - 1 :])
    keep = np.full(len(grams), False)
    keep[own] = True
    grams = np.where(keep, grams, tk.U64(0))
    r, item, first, last = _windows(items, w, grams, row)
    found: dict[tuple[int, int], tuple[float, int, int]] = {}
    ids = items.known(w.hashes)
    local = np.zeros(len(items.vocabulary) + 1, np.int64)
    order = np.lexsort((last - first, item))
    of, begins = np.unique(item[order], return_index=True)
    for k, lo, hi in zip(of.tolist(), begins, np.r_[begins, len(order)][1:], strict=True):
        mine, words = order[lo:hi], items.words[k]
        need = least_score(len(words))
        own, held = np.unique(items.word_ids[k], return_counts=True)
        local[own] = np.arange(1, len(own) + 1)
        mine = mine[_common(local, held, ids, first[mine], last[mine]) >= need]
        local[own] = 0
        for i in range(0, len(mine), 64):
            some = mine[i : i + 64]
            length = last[some] - first[some]
            grid = first[some][:, None] + np.arange(length.max())
            block = np.where(grid < last[some][:, None], w.hashes[np.minimum(grid, len(w.hashes) - 1)], _PAD)
            score, end = align(words, block)
            for j in np.flatnonzero(score >= need):
                key = (int(r[some[j]]), int(k))
                if key not in found or score[j] > found[key][0]:
                    # The alignment backwards from its end gives where it starts.
                    back = block[j, : end[j]][::-1][None, :]
                    begin = int(end[j]) - int(align(words[::-1], back)[1][0])
                    at = int(first[some[j]] - w.at[key[0]])
                    found[key] = (float(score[j]), at + begin, at + int(end[j]))
    for (a, k), (score, i, j) in sorted(found.items()):
        yield a, k, score / len(items.words[k]), i, j


_FOUND = "doc_id long, item_id long, score double, first_word long, end_word long"


def _find(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for b in batches:
            ids = b.column(0)
            data, offsets = tk.buffers(b.column(1))
            rows = [(i + r, k, *x) for i, _, part, at in tk.chunks(data, offsets) for r, k, *x in matches(items, part, at)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(columns[0], pa.int64())), pa.array(items.ids[np.array(columns[1], np.int64)]), pa.array(columns[2], pa.float64()), pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.int64())], names=["doc_id", "item_id", "score", "first_word", "end_word"])

    return run


def item_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[Items]:
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id is not null and text is not null").groupBy("item_id").agg(F.min("text").alias("text"))
    blocks = max(1, -(-text_bytes(items) // block_bytes))
    for k in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).collect()
        rows.sort(key=lambda r: r["item_id"])
        yield Items([r["item_id"] for r in rows], [r["text"] for r in rows])


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id") -> DataFrame:
    """(doc_id, item_id, score, first_word, end_word): one row per reported pair of a row of ``docs`` and an item."""
    spark = docs.sparkSession
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = spark.createDataFrame([], _FOUND)
    for items in item_blocks(benchmark):
        if not len(items.ids):
            continue
        out = out.unionByName(texts.mapInArrow(tidied_batches(_find(spark.sparkContext.broadcast(items))), _FOUND))
    return out


def _clean(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for b in batches:
            data, offsets = tk.buffers(b.column("text"))
            bad = np.zeros(b.num_rows, bool)
            for i, _, part, at in tk.chunks(data, offsets):
                bad[[i + m[0] for m in matches(items, part, at)]] = True
            yield b.filter(pa.array(~bad))

    return run


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item; every column stays."""
    spark = docs.sparkSession
    out = docs
    for items in item_blocks(benchmark):
        if not len(items.ids):
            continue
        out = out.mapInArrow(tidied_batches(_clean(spark.sparkContext.broadcast(items))), out.schema)
    return out


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
