"""License scans: phrases, and an exact set-similarity join of text blocks with templates.

A block is a line, or a window of words that runs across line feeds, as long as
the template over THRESHOLD; its tokens are its distinct words.  A block meets a
template of m distinct words when it has at least ceil(THRESHOLD * m) =: a of them.

1. One pass counts the corpus frequency of the templates' words (partition sums
   over the fixed vocabulary), which orders them globally, rare first.
2. A block with a common words has one of the m - a + 1 rarest: these prefixes
   make an inverted index from words to templates.  A line's words, sorted by the
   global order, are looked up in it.  The length filter wants a distinct words of
   the line at least, the positional filter a of them from the matching one on:
   the first match of a line that meets the template leaves room for them.
3. What is left is verified by counting its distinct common words.
4. A window begins at a template's word.  It is dropped unless it holds a of the
   template's words, repeated or not, one of them from the prefix.  Of windows
   that overlap, the one with the most distinct words counts, and of those the
   first no longer than the template (or the shortest); it takes the place of
   lines that it overlaps and that hold fewer.  It borrows no words: a window that
   overlaps a line which meets a template of another label, and holds more of
   that, is left out.
5. Templates may be alike (a text of one would meet the other).  Of overlapping
   blocks of such templates with different labels the one that holds the larger
   share of its template counts, of equal shares the one with more words.

Templates and phrases are fixed and small, so they travel to the executors and no
text is shuffled.

Defined results: null texts are empty; rows are scanned one by one, repeated or
not; lines longer than any template are whole blocks too.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .support import partition_sums, table, tidied_batches

THRESHOLD = 0.8

# Phrases and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Notices as they are commonly written, and their labels.
TEMPLATES = {
    "Released under the MIT License": "mit",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files": "mit",
    "Licensed under the Apache License, Version 2.0": "apache-2",
    "You may not use this file except in compliance with the License. You may obtain a copy of the License at": "apache-2",
    "Licensed under CC BY-NC 4.0": "cc-by-nc",
    "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License": "cc-by-nc",
    "This work is licensed under a Creative Commons Attribution 4.0 International License": "cc-by",
    "This work is licensed under the GNU General Public License, version 3": "gpl-3",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License": "gpl",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met": "bsd",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0": "mpl-2",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License": "agpl",
    "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License": "lgpl",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License": "cc-by-sa",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "This is free and unencumbered software released into the public domain": "unlicense",
    "Distributed under the Boost Software License, Version 1.0": "boost-1",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0": "epl-2",
    "SPDX-License-Identifier: MIT": "mit",
    "SPDX-License-Identifier: ISC": "isc",
}


def _hashes(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return tk.Words(data, np.array([0, len(data)]), alnum=True).hashes


class Scanner:
    """Phrases and templates by word hash; ``frequency`` (by word hash) orders the templates' words."""

    def __init__(self, frequency: dict[int, int] | None = None, phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None, threshold: float = THRESHOLD):
        self.phrases = [(_hashes(p), label) for p, label in (PHRASES if phrases is None else phrases).items()]
        self.templates, self.vocabulary = [], np.zeros(0, np.uint64)
        sets = [(np.unique(_hashes(t)), label) for t, label in (TEMPLATES if templates is None else templates).items()]
        if sets:
            self.vocabulary = np.unique(np.concatenate([s for s, _ in sets]))
        often = np.array([(frequency or {}).get(int(v), 0) for v in self.vocabulary], np.int64)
        for words, label in sets:
            at = np.searchsorted(self.vocabulary, words)
            order = at[np.lexsort((words, often[at]))]
            need = int(np.ceil(threshold * len(order) - 1e-9))
            self.templates.append((order, need, label))
        # Words of each template, and of the longest block across lines for it.
        self.lengths = [len(_hashes(t)) for t in (TEMPLATES if templates is None else templates)]
        self.widths = [int(np.ceil(n / threshold - 1e-9)) for n in self.lengths]
        # position[t, v]: place of a vocabulary word in a template's order, or past its end.
        self.position = np.full((len(sets), len(self.vocabulary)), 1 << 20, np.int64)
        for t, (order, _, _) in enumerate(self.templates):
            self.position[t, order] = np.arange(len(order))
        # The global order, and the prefix index: templates by word.
        self.rank = np.empty(len(self.vocabulary), np.int64)
        self.rank[np.lexsort((self.vocabulary, often))] = np.arange(len(self.vocabulary))
        prefix = [(v, t) for t, (order, need, _) in enumerate(self.templates) for v in order[: len(order) - need + 1].tolist()]
        prefix = np.array(sorted(prefix), np.int64).reshape(-1, 2)
        self.post = np.searchsorted(prefix[:, 0], np.arange(len(self.vocabulary) + 1))
        self.post_template = prefix[:, 1]
        self.needs = np.array([need for _, need, _ in self.templates], np.int64)
        # alike[t]: templates of another label that a text of t meets, or whose text meets t.
        own = [set(order.tolist()) for order, _, _ in self.templates]
        self.alike = [[u for u, (_, needs, another) in enumerate(self.templates) if another != label and len(own[t] & own[u]) >= min(need, needs)] for t, (_, need, label) in enumerate(self.templates)]
        self.table = np.zeros(1 << 16, bool)
        self.table[(self.vocabulary >> tk.U64(48)).astype(np.int64)] = True

    def known(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, vocabulary indices) of words that some template has."""
        maybe = np.flatnonzero(self.table[(hashes >> tk.U64(48)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.vocabulary, hashes[maybe]), len(self.vocabulary) - 1)
        hit = self.vocabulary[at] == hashes[maybe]
        return maybe[hit], at[hit]

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> dict[str, list]:
        w = tk.Words(data, offsets, alnum=True)
        n = len(offsets) - 1
        h, row = w.hashes, np.repeat(np.arange(n), w.counts)
        base = np.zeros(n, np.int64)
        first, last = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
        labels: dict[int, set] = {}
        scores = np.zeros(n)
        for words, label in self.phrases:
            k = len(words)
            if len(h) < k:
                continue
            at = np.flatnonzero(h[: len(h) - k + 1] == words[0])
            for j in range(1, k):
                at = at[h[at + j] == words[j]]
            at = at[row[at] == row[at + k - 1]]
            r, place = row[at], at - w.at[row[at]]
            base += np.bincount(r, minlength=n)
            np.minimum.at(first, r, place)
            np.maximum.at(last, r, place)
            scores[r] = 1.0
            for x in np.unique(r).tolist():
                labels.setdefault(x, set()).add(label)
        own = {r: set(x) for r, x in labels.items()}
        spans: dict[int, list] = {}
        for r, a, b, label, share in self._blocks(w, data, offsets) if self.templates else ():
            labels.setdefault(r, set()).add(label)
            scores[r] = max(scores[r], share)
            spans.setdefault(r, []).append(f"{label}:{a}:{b}")
        text = lambda found: [",".join(sorted(found.get(r, ()))) for r in range(n)]
        seen = base > 0
        return {"n_words": w.counts, "n_base": base, "first_word": np.where(seen, first, 0), "last_word": np.where(seen, last, 0), "seen": seen, "base_labels": text(own), "labels": text(labels), "score": scores, "blocks": [",".join(spans.get(r, ())) for r in range(n)]}

    def _blocks(self, w: tk.Words, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple]:
        """(row, first word, end word, label, containment) of each line or window that meets a template."""
        place, v = self.known(w.hashes)
        if not len(place):
            return
        feeds = np.flatnonzero(data == 10)
        # A line's number: line feeds before it plus rows before it, so it never spans rows.
        line = np.searchsorted(feeds, w.starts[place]) + np.searchsorted(offsets, w.starts[place], "right")
        every = place, v, line
        order = np.lexsort((self.rank[v], line))
        place, v, line = place[order], v[order], line[order]
        new = np.r_[True, (line[1:] != line[:-1]) | (v[1:] != v[:-1])]
        place, v, line = place[new], v[new], line[new]
        bounds = np.r_[np.flatnonzero(np.r_[True, line[1:] != line[:-1]]), len(line)]
        # Each word of a line against the prefix index: (line, template) where a template's least number of words has room.
        of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        left = bounds[of + 1] - np.arange(len(v))
        held = self.post[v + 1] - self.post[v]
        ends = np.cumsum(held)
        word = np.repeat(np.arange(len(v)), held)
        template = self.post_template[np.repeat(self.post[v] - (ends - held), held) + np.arange(ends[-1])]
        room = left[word] >= self.needs[template]
        met = np.unique(of[word[room]] * len(self.templates) + template[room])
        lines: list[list] = [[] for _ in self.templates]
        for k, t in zip((met // len(self.templates)).tolist(), (met % len(self.templates)).tolist(), strict=True):
            at = slice(bounds[k], bounds[k + 1])
            own = place[at][self.position[t][v[at]] < len(self.templates[t][0])]
            if len(own) >= self.needs[t]:
                lines[t].append((int(own.min()), int(own.max()) + 1, len(own)))
        found: list[list] = []
        for t, (words, _, label) in enumerate(self.templates):
            windows = self._windows(t, w, *every)
            for u, (other, _, another) in enumerate(self.templates if windows else ()):
                if another != label:
                    windows = [x for x in windows if _most(lines[u], x) * len(words) <= x[2] * len(other)]
            found.append(_merged(lines[t], windows))
        for t, (words, _, label) in enumerate(self.templates):
            rivals = [(found[u], len(self.templates[u][0])) for u in self.alike[t] if found[u]] if found[t] else ()
            for a, b, common in found[t]:
                if any((most * len(words), most) > (common * m, common) for most, m in ((_most(blocks, (a, b)), m) for blocks, m in rivals)):
                    continue
                r = int(np.searchsorted(offsets, w.starts[a], "right")) - 1
                yield r, int(a - w.at[r]), int(b - w.at[r]), label, common / len(words)

    def _windows(self, t: int, w: tk.Words, place: np.ndarray, v: np.ndarray, line: np.ndarray) -> list[tuple]:
        """(first word, end word, distinct words) of windows across line feeds that meet template ``t``, none overlapping."""
        words, need, _ = self.templates[t]
        pos = self.position[t][v]
        own = np.flatnonzero(pos < len(words))
        place, pos, line = place[own], pos[own], line[own]
        rare = np.r_[0, np.cumsum(pos <= len(words) - need)]
        if not rare[-1]:
            return []
        row_end = w.at[np.searchsorted(w.at, place, "right")]
        stop = np.searchsorted(place, np.minimum(place + self.widths[t], row_end))
        at = np.arange(len(place))
        at = at[(stop - at >= need) & (rare[stop] > rare[at]) & (line[stop - 1] > line)]
        if not len(at):
            return []
        # A word is new to a window that begins after the word's occurrence before.
        order = np.argsort(pos, kind="stable")
        before = np.full(len(place), -1)
        same = pos[order][1:] == pos[order][:-1]
        before[order[1:][same]] = order[:-1][same]
        held = stop[at] - at
        ends = np.cumsum(held)
        flat = np.repeat(at - (ends - held), held) + np.arange(ends[-1])
        fresh = before[flat] < np.repeat(at, held)
        common = np.add.reduceat(fresh.astype(np.int64), ends - held)
        last = np.maximum.reduceat(np.where(fresh, flat, 0), ends - held)
        met = np.flatnonzero((common >= need) & (line[last] > line[at]))
        out, i = [], 0
        while i < len(met):
            # Of the windows that overlap the first one: the most words, then the first no longer than the template, or the shortest.
            j = i + int(np.searchsorted(at[met[i:]], last[met[i]], "right"))
            extent = place[last[met[i:j]]] + 1 - place[at[met[i:j]]]
            fits = extent <= self.lengths[t]
            k = i + int(np.lexsort((np.where(fits, np.arange(i, j), extent), ~fits, -common[met[i:j]]))[0])
            out.append((int(place[at[met[k]]]), int(place[last[met[k]]]) + 1, int(common[met[k]])))
            i = max(j, int(np.searchsorted(at[met], last[met[k]], "right")))
        return out


def _most(lines: list[tuple], window: tuple) -> int:
    """The most words that a line which overlaps the window holds."""
    i = bisect.bisect_right(lines, window[0], key=lambda x: x[1])
    j = bisect.bisect_left(lines, window[1], key=lambda x: x[0])
    return max((x[2] for x in lines[i:j]), default=0)


def _merged(lines: list[tuple], windows: list[tuple]) -> list[tuple]:
    """Lines and windows in order; where they overlap, the windows that hold more words, else the lines."""
    out, i = [], 0
    for window in windows:
        while i < len(lines) and lines[i][1] <= window[0]:
            out.append(lines[i])
            i += 1
        j = i
        while j < len(lines) and lines[j][0] < window[1]:
            j += 1
        if max((x[2] for x in lines[i:j]), default=0) < window[2]:
            out.append(window)
            i = j
    return out + lines[i:]


def _frequencies(scanner: Scanner):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(scanner.vocabulary), np.int64)
        for b in batches:
            data, offsets = tk.buffers(b.column(0))
            for _, _, part, at in tk.chunks(data, offsets):
                counts += np.bincount(scanner.known(tk.Words(part, at, alnum=True).hashes)[1], minlength=len(counts))
        yield pa.RecordBatch.from_pydict({"key": pa.array(["n"]), "blob": pa.array([counts.tobytes()], pa.binary())})

    return run


def _scan(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = shared.value
        for b in batches:
            data, offsets = tk.buffers(b.column("text"))
            for i, j, part, at in tk.chunks(data, offsets):
                x = scanner.scan(part, at)
                none = pa.array(~x["seen"])
                columns = [b.column("doc_id").slice(i, j - i), pa.array(x["n_words"].astype(np.int64)), pa.array(x["n_base"])]
                columns += [pa.array(x[k].astype(np.int64), mask=none.to_numpy(zero_copy_only=False)) for k in ("first_word", "last_word")]
                columns += [pa.array(x[k], pa.string()) for k in ("base_labels", "labels")] + [pa.array(x["score"]), pa.array(x["blocks"], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks"])

    return run


def scan_licenses(docs: DataFrame, phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks (label:first:end in words)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    plain = Scanner(None, phrases, templates, threshold)
    frequency = {}
    if len(plain.vocabulary):
        sums = partition_sums(texts.select("text").mapInArrow(tidied_batches(_frequencies(plain)), "key string, blob binary"), "<i8")
        frequency = dict(zip(plain.vocabulary.tolist(), sums["n"].tolist(), strict=True)) if sums else {}
    scanner = docs.sparkSession.sparkContext.broadcast(Scanner(frequency, phrases, templates, threshold))
    return texts.mapInArrow(tidied_batches(_scan(scanner)), "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, blocks string")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
