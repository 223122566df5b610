"""Suffix-array dedup: remove bytes covered by strings that also start in an earlier document.

A window is a string of LENGTH bytes.  Suffix buckets are dealt by content, so
that equal windows meet: a window's label is the hash of its least inner string
of GRAM bytes (a minimizer), and consecutive windows with one label and one
minimizer place form a run, whose bytes are the run's excerpt.

1. Documents are dealt to groups of bounded bytes.  Each group sends its distinct
   labels to label buckets; labels of two documents or more come back.  Windows
   under other labels repeat nowhere and leave here, which loses nothing, since
   equal windows have equal labels.
2. Each group sends, per label, the distinct excerpts of its remaining runs with
   the least document that holds each; a larger document holding the same excerpt
   in the group is settled there.  So a passage in a third of all rows is one row
   per group in any bucket.
3. A bucket sorts the suffixes of its excerpts block by block with a difference
   cover (suffixes.py): a block has whole labels, excerpts aligned at the
   minimizer, and one suffix bucket for each column.  Neighbours that share
   LENGTH bytes form a class; a member whose document is not the class's least is
   repeated, and so are its run-mates.  Spans return to the groups.
4. Groups merge the spans of each document and cut the bytes.

Defined results: null texts are empty; windows never cross documents; rows with
a null id lose nothing and count for nobody; rows that share an id are one
document (equal ids are not smaller); an empty table gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .suffixes import PERIOD, Block
from .support import table, text_bytes, tidied, tidied_pair

LENGTH = 50
GRAM = 24
GROUP_BYTES = 4 << 20
BLOCK_ROWS = 60_000


def _runs(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(label, minimizer place, first window, windows) of each run of some rows, as byte positions."""
    w = length - gram + 1
    h = tk.mix(tk.gram_hashes(data, gram)) if len(data) >= length else np.zeros(0, np.uint64)
    if len(h) < w:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none
    # Sliding minimum over w places by doubling.
    low, size = h, 1
    while 2 * size <= w:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    low = np.minimum(low[: len(h) - w + 1], low[w - size :][: len(h) - w + 1])
    row_end = np.repeat(offsets[1:], np.diff(offsets))[: len(low)]
    inside = np.arange(len(low)) + length <= row_end
    change = np.ones(len(low), bool)
    change[1:] = (low[1:] != low[:-1]) | ~inside[:-1]
    change &= inside
    first = np.flatnonzero(change)
    label = low[first]
    # Where the run ends: at the next run, or at the last window of its row.
    stop = np.minimum(np.r_[first[1:], len(low)], row_end[first] - length + 1) if len(first) else first
    # The minimizer's first place at or after the run's first window; a label that goes on longer than its
    # minimizer's reach has several places and is cut where the first leaves the window.
    out = []
    label, first, stop = label, first, stop
    while len(first):
        place = first.copy()
        todo = np.flatnonzero(h[place] != label)
        while len(todo):
            place[todo] += 1
            todo = todo[h[place[todo]] != label[todo]]
        end = np.minimum(stop, place + 1)
        out.append((label, place, first, end - first))
        more = end < stop
        label, first, stop = label[more], end[more], stop[more]
    if not out:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _rows(t: pa.Table) -> pa.Table:
    """A group's rows in an order that no shuffle changes."""
    return t.sort_by([("doc_id", "ascending"), ("text", "ascending")])


def _group_runs(t: pa.Table, length: int, gram: int) -> Iterator[tuple]:
    """(bytes, row, id, label, place, first, count) by chunk of rows with an id; positions within the chunk."""
    ids = t["doc_id"].combine_chunks()
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    doc = ids.fill_null(0).to_numpy(zero_copy_only=False)
    data, offsets = tk.buffers(t["text"])
    for i, _, part, at in tk.chunks(data, offsets, 1 << 20):
        label, place, first, count = _runs(part, at, length, gram)
        row = np.searchsorted(at, first, "right") - 1
        own = known[i + row]
        yield part, at, i + row[own], doc[i + row[own]], label[own], place[own], first[own], count[own], row[own]


def _bucket(label: np.ndarray, buckets: int) -> np.ndarray:
    return ((label >> tk.U64(40)) * tk.U64(buckets) >> tk.U64(24)).astype(np.int32)


def _key(label: np.ndarray, buckets: int) -> np.ndarray:
    """What stands for a label: its bucket and 40 of its other bits.  A clash costs work, never a result."""
    return (_bucket(label, buckets).astype(np.uint64) << tk.U64(40)) | (label & tk.U64((1 << 40) - 1))


def _pack(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _unpack(bucket: int, blob: bytes) -> np.ndarray:
    five = np.frombuffer(blob, np.uint8).reshape(-1, 5)
    out = np.zeros((len(five), 8), np.uint8)
    out[:, :5] = five
    return out.view("<u8").ravel() | (tk.U64(bucket) << tk.U64(40))


def _squeeze(data: bytes) -> bytes:
    return pa.Codec("zstd", 1).compress(data, asbytes=True)


def _expand(blob: bytes, size: int, dtype) -> np.ndarray:
    return np.frombuffer(pa.Codec("zstd").decompress(blob, size, asbytes=True), dtype)


_LABELS = "bucket int, g int, labels binary, many binary"


def _labels(buckets: int, length: int, gram: int):
    def run(t: pa.Table) -> pa.Table:
        t = _rows(t)
        labels, docs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for _, _, _, doc, label, *_ in _group_runs(t, length, gram):
            labels.append(_key(label, buckets))
            docs.append(doc)
        label, doc = np.concatenate(labels), np.concatenate(docs)
        del labels, docs
        order = np.argsort(label, kind="stable")
        label, doc = label[order], doc[order]
        first = np.flatnonzero(np.r_[True, label[1:] != label[:-1]]) if len(label) else np.zeros(0, np.int64)
        many = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first) if len(first) else np.zeros(0, bool)
        label = label[first]
        b = label >> tk.U64(40)
        cut = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(b) else np.zeros(0, np.int64)
        g = t["g"][0].as_py()
        rows = [{"bucket": int(b[i]), "g": g, "labels": _pack(label[i:j]), "many": np.packbits(many[i:j]).tobytes()} for i, j in zip(cut, [*cut[1:], len(b)][: len(cut)], strict=True)]
        return pa.Table.from_pylist(rows, schema=pa.schema([("bucket", pa.int32()), ("g", pa.int32()), ("labels", pa.binary()), ("many", pa.binary())]))

    return run


def _shared(t: pa.Table) -> pa.Table:
    """Of a bucket's labels, those of two documents or more, back to each group that has them."""
    group = t["g"].to_pylist()
    bucket = t["bucket"][0].as_py()
    sets = [_unpack(bucket, x.as_py()) for x in t["labels"]]
    label = np.concatenate(sets)
    many = np.concatenate([np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=len(s)) for x, s in zip(t["many"], sets, strict=True)]).astype(bool)
    order = np.argsort(label, kind="stable")
    s = label[order]
    first = np.r_[True, s[1:] != s[:-1]]
    alone = first & np.r_[first[1:], True]
    keep = np.empty(len(s), bool)
    keep[order] = ~alone
    keep |= many
    out, at = [], 0
    for g, x in zip(group, sets, strict=True):
        own = x[keep[at : at + len(x)]]
        at += len(x)
        if len(own):
            out.append({"g": g, "bucket": bucket, "labels": _pack(own)})
    return pa.Table.from_pylist(out, schema=pa.schema([("g", pa.int32()), ("bucket", pa.int32()), ("labels", pa.binary())]))


_EXCERPTS = pa.schema([("bucket", pa.int32()), ("g", pa.int32()), ("kind", pa.int32()), ("n", pa.int32()), ("m", pa.int32()), ("head", pa.binary()), ("shape", pa.binary()), ("bytes", pa.binary())])
_HEAD = np.dtype([("doc", "<i8"), ("row", "<i4"), ("start", "<i8"), ("ex", "<i4")])
_SHAPE = np.dtype([("count", "u1"), ("lead", "u1")])
_SPAN = np.dtype([("row", "<i4"), ("start", "<i8"), ("end", "<i8")])
_EXCERPT, _SETTLED = 0, 1


def _excerpts(buckets: int, length: int, gram: int):
    def run(t: pa.Table, labels: pa.Table) -> pa.Table:
        if not t.num_rows or not labels.num_rows:
            return _EXCERPTS.empty_table()
        t = _rows(t)
        g = t["g"][0].as_py()
        wanted = np.sort(np.concatenate([_unpack(k, x) for k, x in zip(labels["bucket"].to_pylist(), labels["labels"].to_pylist(), strict=True)]))
        heads, shapes, parts, keys, names = [], [], [], [], []
        for part, at, row, doc, label, place, first, count, local in _group_runs(t, length, gram):
            name = _key(label, buckets)
            i = np.minimum(np.searchsorted(wanted, name), len(wanted) - 1)
            own = np.flatnonzero(wanted[i] == name)
            row, doc, label, place, first, count, local = (x[own] for x in (row, doc, label, place, first, count, local))
            head = np.empty(len(own), _HEAD)
            head["doc"], head["row"], head["start"] = doc, row, first - at[local]
            shape = np.empty(len(own), _SHAPE)
            shape["count"], shape["lead"] = count, place - first
            shapes.append(shape)
            size = count + length - 1
            ends = np.cumsum(size)
            flat = part[np.repeat(first - (ends - size), size) + np.arange(ends[-1])] if len(own) else np.zeros(0, np.uint8)
            keys.append(tk.row_hash(flat, np.r_[0, ends], salt=6) ^ tk.mix((place - first).astype(np.uint64)))
            heads.append(head)
            parts.append(flat)
            names.append(label)
        head, shape, flat, key, label = (np.concatenate(x) for x in (heads, shapes, parts, keys, names))
        size = shape["count"].astype(np.int64) + length - 1
        at = np.r_[0, np.cumsum(size)]
        # Equal excerpts (same hash of bytes and lead): the least document goes on, larger ones are settled here.
        order = np.lexsort((head["row"], head["doc"], key, label))
        k, d, n = key[order], head["doc"][order], label[order]
        first = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (n[1:] != n[:-1])]) if len(k) else np.zeros(0, np.int64)
        least = np.repeat(d[first], np.diff(np.r_[first, len(k)]))
        done, goes = order[d > least], order[d == least]
        spans = np.empty(len(done), _SPAN)
        spans["row"], spans["start"], spans["end"] = head["row"][done], head["start"][done], head["start"][done] + size[done]
        rows = [{"bucket": g % buckets, "g": g, "kind": _SETTLED, "n": len(done := merge_spans(spans)), "head": _squeeze(done.tobytes())}] if len(done) else []
        # Each distinct excerpt goes once; places of its least document refer to it.
        distinct = order[first]
        head["ex"][order] = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(k)]))
        b = _bucket(label[distinct], buckets)
        cut = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(b) else np.zeros(0, np.int64)
        held = np.searchsorted(head["ex"][goes], np.r_[cut, len(b)])
        for x, (i, j) in enumerate(zip(cut, [*cut[1:], len(b)][: len(cut)], strict=True)):
            own, places = distinct[i:j], head[goes[held[x] : held[x + 1]]]
            places["ex"] -= i
            rows.append({"bucket": int(b[i]), "g": g, "kind": _EXCERPT, "n": len(places), "m": len(own), "head": _squeeze(places.tobytes()), "shape": _squeeze(shape[own].tobytes()), "bytes": _squeeze(_pieces(flat, at[own], size[own]).tobytes())})
        return pa.Table.from_pylist(rows, schema=_EXCERPTS)

    return run


def _pieces(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Bytes of the given stretches, joined."""
    ends = np.cumsum(size)
    return flat[np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]


def merge_spans(spans: np.ndarray) -> np.ndarray:
    """Union of spans of each row, as maximal runs."""
    if not len(spans):
        return spans
    spans = spans[np.lexsort((spans["start"], spans["row"]))]
    far = spans["end"].max() + 1
    reach = np.maximum.accumulate(spans["row"] * far + spans["end"]) - spans["row"] * far
    new = np.r_[True, (spans["row"][1:] != spans["row"][:-1]) | (spans["start"][1:] > reach[:-1])]
    at = np.flatnonzero(new)
    out = spans[at].copy()
    out["end"] = np.maximum.reduceat(spans["end"], at)
    return out


def _least_documents(doc: np.ndarray, shape: np.ndarray, flat: np.ndarray, length: int, gram: int) -> np.ndarray:
    """For each distinct excerpt and window of its run: the least document with that window (matrix)."""
    w = length - gram + 1
    size = shape["count"].astype(np.int64) + length - 1
    at = np.r_[0, np.cumsum(size)]
    # Excerpts are aligned so that the minimizer is in column w - 1 and a window that starts lead bytes before it in w - 1 - lead.
    width = length + w - 1
    block = np.zeros((len(doc), -(-width // PERIOD) * PERIOD + 2 * PERIOD), np.uint8)
    begin = w - 1 - shape["lead"].astype(np.int64)
    inside = np.arange(at[-1]) - np.repeat(at[:-1], size)
    block[np.repeat(np.arange(len(doc)), size), np.repeat(begin, size) + inside] = flat
    suffixes = Block(block)
    least = np.repeat(doc[:, None], w, axis=1)
    for column in range(w):
        rows = np.flatnonzero((begin <= column) & (column < begin + shape["count"]))
        if len(rows) < 2:
            continue
        rows = suffixes.sort_bucket(column, rows)
        first = np.flatnonzero(~suffixes.equal_to_last(column, rows, length))
        least[rows, column - begin[rows]] = np.repeat(np.minimum.reduceat(doc[rows], first), np.diff(np.r_[first, len(rows)]))
    return least


def _repeats(length: int, gram: int, block_rows: int):
    def run(t: pa.Table) -> pa.Table:
        sent = [r for r in t.to_pylist() if r["kind"] == _EXCERPT]
        out = [(r["g"], _expand(r["head"], r["n"] * _SPAN.itemsize, _SPAN)) for r in t.to_pylist() if r["kind"] == _SETTLED]
        if sent:
            heads = [_expand(r["head"], r["n"] * _HEAD.itemsize, _HEAD).copy() for r in sent]
            shape = np.concatenate([_expand(r["shape"], r["m"] * _SHAPE.itemsize, _SHAPE) for r in sent])
            size = shape["count"].astype(np.int64) + length - 1
            at = np.r_[0, np.cumsum(size)]
            cuts = np.cumsum([0, *(r["m"] for r in sent)])
            flat = np.concatenate([_expand(r["bytes"], int(at[j] - at[i]), np.uint8) for r, i, j in zip(sent, cuts, cuts[1:], strict=False)])
            for h, i in zip(heads, cuts, strict=False):
                h["ex"] += i
            head = np.concatenate(heads)
            of = np.repeat([r["g"] for r in sent], [r["n"] for r in sent])
            # Equal excerpts of different groups fold into one, with the least document.
            key = tk.row_hash(flat, at, salt=6) ^ tk.mix(shape["lead"].astype(np.uint64))
            _, own, fold = np.unique(key, return_index=True, return_inverse=True)
            doc = np.full(len(own), np.iinfo(np.int64).max)
            np.minimum.at(doc, fold[head["ex"]], head["doc"])
            shape, start, size = shape[own], at[own], size[own]
            # Labels again, from the minimizers: blocks of whole labels, one sorted at a time.
            gram_bytes = _pieces(flat, start + shape["lead"], np.full(len(own), gram))
            label = tk.row_hash(gram_bytes, np.arange(0, len(gram_bytes) + 1, gram))
            order = np.argsort(label, kind="stable")
            s = label[order]
            stops = np.r_[np.flatnonzero(s[1:] != s[:-1]) + 1, len(order)]
            # Places by excerpt, excerpts in block order.
            rank = np.empty(len(own), np.int64)
            rank[order] = np.arange(len(own))
            at_block = rank[fold[head["ex"]]]
            by = np.argsort(at_block, kind="stable")
            at_block = at_block[by]
            lo, spans = 0, []
            while lo < len(order):
                # Whole labels, about block_rows excerpts, one label at least.
                k = max(int(np.searchsorted(stops, lo + block_rows, "right")) - 1, int(np.searchsorted(stops, lo, "right")))
                hi = int(stops[k])
                some = order[lo:hi]
                least = _least_documents(doc[some], shape[some], _pieces(flat, start[some], size[some]), length, gram)
                i, j = np.searchsorted(at_block, [lo, hi])
                for c in range(i, j, 1 << 16):
                    places = by[c : min(j, c + (1 << 16))]
                    e = at_block[c : c + len(places)] - lo
                    inside = np.arange(least.shape[1]) < shape["count"][some[e]][:, None]
                    r, window = np.nonzero((least[e] < head["doc"][places][:, None]) & inside)
                    x = np.empty(len(r), _SPAN)
                    x["row"], x["start"] = head["row"][places[r]], head["start"][places[r]] + window
                    x["end"] = x["start"] + length
                    group = of[places[r]]
                    back = np.argsort(group, kind="stable")
                    for g, own_spans in _by_group(group[back], x[back]):
                        spans.append((g, merge_spans(own_spans)))
                lo = hi
            out += spans
        return pa.table({"g": pa.array([g for g, _ in out], pa.int32()), "spans": pa.array([x.tobytes() for _, x in out], pa.binary())})

    return run


def _by_group(group: np.ndarray, values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    cut = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, np.int64)
    for i, j in zip(cut, [*cut[1:], len(group)][: len(cut)], strict=True):
        yield int(group[i]), values[i:j]


_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def _cut_out(with_bytes: bool):
    def run(t: pa.Table, spans: pa.Table) -> pa.Table:
        if not t.num_rows:
            return _OUT.empty_table()
        t = _rows(t)
        found = [np.frombuffer(x.as_py(), _SPAN) for x in spans["spans"]]
        s = merge_spans(np.concatenate(found)) if found else np.zeros(0, _SPAN)
        cut = np.searchsorted(s["row"], np.arange(t.num_rows + 1))
        data, offsets = tk.buffers(t["text"])
        rows = []
        for r, doc in enumerate(t["doc_id"].to_pylist()):
            text, own = data[offsets[r] : offsets[r + 1]], s[cut[r] : cut[r + 1]]
            kept = text
            if len(own):
                flags = np.zeros(len(text) + 1, np.int8)
                flags[own["start"]] += 1
                flags[own["end"]] -= 1
                kept = text[np.cumsum(flags[:-1]) == 0]
            body = kept.tobytes()
            rows.append({"doc_id": doc, "n_bytes": len(text), "n_removed": len(text) - len(body), "n_spans": len(own), "kept_sha256": hashlib.sha256(body).hexdigest(), "kept": body if with_bytes else None})
        return pa.Table.from_pylist(rows, schema=_OUT)

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group_bytes: int = GROUP_BYTES, block_rows: int = BLOCK_ROWS, with_bytes: bool = False) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and ``kept``, the remaining bytes)."""
    groups = max(8, -(-text_bytes(docs) // group_bytes))
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    dealt = dealt.withColumn("g", F.pmod(F.xxhash64(F.coalesce("doc_id", F.octet_length("text").cast("long"))), F.lit(groups)).cast("int"))
    shared = dealt.groupBy("g").applyInArrow(tidied(_labels(groups, length, gram)), _LABELS).groupBy("bucket").applyInArrow(tidied(_shared), "g int, bucket int, labels binary")
    cut = dealt.groupBy("g").cogroup(shared.groupBy("g")).applyInArrow(tidied_pair(_excerpts(groups, length, gram)), "bucket int, g int, kind int, n int, m int, head binary, shape binary, bytes binary")
    spans = cut.groupBy("bucket").applyInArrow(tidied(_repeats(length, gram, block_rows)), "g int, spans binary")
    out = dealt.groupBy("g").cogroup(spans.groupBy("g")).applyInArrow(tidied_pair(_cut_out(with_bytes)), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out if with_bytes else out.drop("kept")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
