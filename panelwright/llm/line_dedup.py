"""Line dedup: a sharded minimal perfect hash over line hashes, probed by documents.

1. Every document sends each distinct line key it holds once, as two 64-bit
   hashes; a grouped count with map-side combine gives the number of documents
   and the largest document id of each key.  Keys held by too few documents can
   never lose a line and leave here.
2. The keys are dealt to shards of bounded size.  A task per shard builds a
   minimal perfect hash (bucketed displacements) over the shard's key hashes
   and lays out three arrays in its order: a 64-bit fingerprint (the second
   hash), the document count and the keeper's id.
   A key whose first hash another key has already goes to a short list beside
   the arrays, which is probed by both hashes.
3. Documents probe the arrays.  An index within ``BROADCAST_BYTES`` travels to
   the executors.  Beyond that probes go to the shards instead, packed by task, a
   shard taking its probes in as many salted groups as keep each near
   ``PROBE_ROWS``, so that no line, however common, fills a task; what they drop
   meets the documents in groups of about ``GROUP_BYTES``.

Defined results: a null or empty text is one empty line; rows with a null id
keep all lines and count for nobody; rows with the same id are one document;
of a key's lines in its keeper all stay; ties do not arise, ids being ordered;
other columns are carried along, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as tk
from .support import free_name, settle, table, text_bytes, tidied, tidied_batches, tidied_pair

MIN_CHARS = 20
MIN_DOCS = 3
SHARD_KEYS = 1 << 18
BROADCAST_BYTES = 48 << 20
PROBE_ROWS = 1 << 20
GROUP_BYTES = 16 << 20
_LOAD = 4  # keys in a displacement bucket, on average
_PAD = b"\x20\x09\x0a\x0b\x0c\x0d"


class Lines:
    """Lines of some rows: byte bounds, stripped bounds, key hashes and whether the key is long enough."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, min_chars: int):
        n = len(offsets) - 1
        feeds = np.flatnonzero(data == 10)
        per_row = np.searchsorted(feeds, offsets[1:]) - np.searchsorted(feeds, offsets[:-1])
        self.counts = per_row + 1
        self.row = np.repeat(np.arange(n), self.counts)
        self.at = np.concatenate([[0], np.cumsum(self.counts)])
        self.start = np.empty(self.at[-1], np.int64)
        self.end = np.empty(self.at[-1], np.int64)
        inner = np.ones(self.at[-1], bool)
        inner[self.at[:-1]] = False
        self.start[inner] = feeds + 1
        self.start[self.at[:-1]] = offsets[:-1]
        inner = np.ones(self.at[-1], bool)
        inner[self.at[1:] - 1] = False
        self.end[inner] = feeds
        self.end[self.at[1:] - 1] = offsets[1:]
        # Strip: first and last byte of each line that is no separator.
        solid = np.flatnonzero(~tk._SEPARATORS[data])
        i, j = np.searchsorted(solid, self.start), np.searchsorted(solid, self.end)
        some = i < j
        self.lo, self.hi = self.start.copy(), self.start.copy()
        self.lo[some], self.hi[some] = solid[i[some]], solid[j[some] - 1] + 1
        points = np.concatenate([[0], np.cumsum(tk.code_points(data))])
        self.long = points[self.hi] - points[self.lo] >= min_chars

    def hashes(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two independent hashes of each long line's key."""
        keep = np.flatnonzero(self.long)
        lo, length = self.lo[keep], (self.hi - self.lo)[keep]
        if not len(keep):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        at = np.concatenate([[0], np.cumsum(length)])
        flat = data[np.repeat(lo - at[:-1], length) + np.arange(at[-1])]
        return tk.row_hash(flat, at, lower=True), tk.row_hash(flat, at, lower=True, salt=77)


_KEYS = pa.schema([("doc_id", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64())])


def _keys(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0)
            data, offsets = tk.buffers(b.column(1))
            for i, j, part, at in tk.chunks(data, offsets):
                lines = Lines(part, at, min_chars)
                h1, h2 = lines.hashes(part)
                row = lines.row[lines.long] + i
                order = np.lexsort((h2, h1, row))
                r, a, c = row[order], h1[order], h2[order]
                new = np.ones(len(r), bool)
                new[1:] = (r[1:] != r[:-1]) | (a[1:] != a[:-1]) | (c[1:] != c[:-1])
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(r[new])), pa.array(a[new].view(np.int64)), pa.array(c[new].view(np.int64))], schema=_KEYS)

    return run


def line_counts(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(h1, h2, n_docs, keeper) of every key held by at least ``min_docs`` documents."""
    keys = docs.select(F.col("doc_id").cast("long"), "text").filter("doc_id is not null").mapInArrow(tidied_batches(_keys(min_chars)), "doc_id long, h1 long, h2 long")
    # Rows of one document id may be spread; a distinct count would shuffle every (key, document), so ids that repeat
    # are folded first and only those.
    repeated = docs.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    if repeated.limit(1).count():
        again = keys.join(repeated, "doc_id", "left_semi").distinct()
        keys = keys.join(repeated, "doc_id", "left_anti").unionByName(again)
    return keys.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keeper")).filter(F.col("n_docs") >= min_docs)


def build_mph(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Displacements and slots of a minimal perfect hash over distinct 64-bit values.

    Keys fall into buckets; from the fullest bucket down, each takes the first
    displacement that sends its keys to slots still free.
    """
    n = len(h)
    m = max(1, -(-n // _LOAD))
    bucket = (tk.mix(h) % tk.U64(m)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    size = np.bincount(bucket, minlength=m)
    at = np.concatenate([[0], np.cumsum(size)])
    shift = np.zeros(m, np.uint32)
    slot = np.empty(n, np.int64)
    taken = np.zeros(n, bool)
    for b in np.argsort(-size, kind="stable"):
        if not size[b]:
            break
        own = order[at[b] : at[b + 1]]
        d = 0
        while True:
            tries = np.arange(d, d + 64, dtype=np.uint64)
            where = _slots(h[own][None, :], tries[:, None], n)
            ok = ~taken[where].any(axis=1)
            if len(own) > 1:
                s = np.sort(where, axis=1)
                ok &= (s[:, 1:] != s[:, :-1]).all(axis=1)
            if ok.any():
                k = int(np.argmax(ok))
                shift[b], slot[own] = d + k, where[k]
                taken[where[k]] = True
                break
            d += 64
    return shift, slot


def _slots(h: np.ndarray, shift: np.ndarray, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (tk.mix(h ^ ((shift.astype(np.uint64) + tk.U64(1)) * tk.U64(tk._BASE))) % tk.U64(n)).astype(np.int64)


_SHARD = "shard int, n int, shift binary, print binary, docs binary, keeper binary, extra binary"
_EXTRA = np.dtype([("h1", "<u8"), ("h2", "<i8"), ("keeper", "<i8")])


def _shard(pdf: pa.Table) -> pa.Table:
    h1 = pdf["h1"].to_numpy().view(np.uint64)
    order = np.lexsort((pdf["h2"].to_numpy(), h1))
    h1, h2 = h1[order], pdf["h2"].to_numpy()[order]
    docs, keeper = pdf["n_docs"].to_numpy()[order], pdf["keeper"].to_numpy()[order]
    # Of keys with one first hash the first has the slot; likely from 2**32 keys on.
    again = np.r_[False, h1[1:] == h1[:-1]]
    extra = np.empty(int(again.sum()), _EXTRA)
    extra["h1"], extra["h2"], extra["keeper"] = h1[again], h2[again], keeper[again]
    h1, h2, docs, keeper = (x[~again] for x in (h1, h2, docs, keeper))
    shift, slot = build_mph(h1)
    arrays = [np.empty(len(h1), np.int64) for _ in range(3)]
    for array, value in zip(arrays, (h2, docs, keeper), strict=True):
        array[slot] = value
    blobs = [shift.tobytes(), *(a.tobytes() for a in arrays), extra.tobytes()]
    return pa.table({"shard": pa.array([pdf["shard"][0].as_py()], pa.int32()), "n": pa.array([len(h1)], pa.int32())} | {k: pa.array([v], pa.binary()) for k, v in zip(("shift", "print", "docs", "keeper", "extra"), blobs, strict=True)})


def build_index(counts: DataFrame, n_keys: int, shard_keys: int = SHARD_KEYS) -> tuple[DataFrame, int]:
    """One row per shard; shards are dealt by the first hash, so each holds about ``shard_keys`` keys at any size."""
    shards = max(1, -(-n_keys // shard_keys))
    dealt = counts.withColumn("shard", F.pmod(F.shiftright("h1", 7), F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInArrow(tidied(_shard), _SHARD), shards


def shard_of(h1: np.ndarray, shards: int) -> np.ndarray:
    return (h1.view(np.int64) >> 7) % shards


def probe(index: dict[int, tuple], shards: int, h1: np.ndarray, h2: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """True where the index knows the key and the document is not its keeper."""
    out = np.zeros(len(h1), bool)
    shard = shard_of(h1, shards)
    for s, (n, shift, prints, keeper, extra) in index.items():
        at = np.flatnonzero(shard == s)
        if len(at) and n:
            h = h1[at]
            slot = _slots(h, shift[(tk.mix(h) % tk.U64(len(shift))).astype(np.int64)], n)
            known = prints[slot] == h2[at].view(np.int64)
            out[at] = known & (keeper[slot] != doc[at])
            for e in extra:
                out[at] |= (h == e["h1"]) & (h2[at].view(np.int64) == e["h2"]) & (doc[at] != e["keeper"])
    return out


def _load(rows) -> dict[int, tuple]:
    return {r["shard"]: (r["n"], np.frombuffer(r["shift"], np.uint32), np.frombuffer(r["print"], np.int64), np.frombuffer(r["keeper"], np.int64), np.frombuffer(r["extra"], _EXTRA)) for r in rows}


def _mark(shared, shards: int, min_chars: int):
    """Adds column ``drops``: the numbers of the lines to drop, as int32s."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _load(shared.value)
        for b in batches:
            yield _with_drops(b, min_chars, lambda h1, h2, doc: probe(index, shards, h1, h2, doc))

    return run


def _with_drops(b: pa.RecordBatch, min_chars: int, dropped) -> pa.RecordBatch:
    """``b`` with column ``drops``, from ``dropped(h1, h2, doc)`` of its long lines in rows with an id."""
    ids = b.column("doc_id").cast(pa.int64())
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    doc = ids.fill_null(0).to_numpy(zero_copy_only=False)
    data, offsets = tk.buffers(b.column("text"))
    drops: list[bytes] = []
    for i, j, part, at in tk.chunks(data, offsets):
        lines = Lines(part, at, min_chars)
        h1, h2 = lines.hashes(part)
        which = np.flatnonzero(lines.long)
        row = lines.row[which] + i
        hit = dropped(h1, h2, doc[row]) & known[row]
        number = (which - lines.at[lines.row[which]])[hit].astype(np.int32)
        cut = np.searchsorted(row[hit], np.arange(i, j + 1))
        drops += [number[cut[k] : cut[k + 1]].tobytes() for k in range(j - i)]
    return b.append_column("drops", pa.array(drops, pa.binary()))


def _no_drops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield b.append_column("drops", pa.array([b""] * b.num_rows, pa.binary()))


_PROBES = pa.schema([("shard", pa.int32()), ("salt", pa.int32()), ("probes", pa.binary())])
_PROBE = np.dtype([("doc", "<i8"), ("h1", "<u8"), ("h2", "<u8")])
_FLUSH = 1_000_000


def _send(shards: int, salts: np.ndarray, min_chars: int):
    """Probes of a partition's lines, packed by shard and salt."""

    def flush(parts: list[np.ndarray]) -> pa.RecordBatch:
        x = np.concatenate(parts)
        shard = shard_of(np.ascontiguousarray(x["h1"]), shards)
        salt = (tk.mix(x["doc"].astype(np.uint64)) % salts[shard].astype(np.uint64)).astype(np.int64)
        order = np.lexsort((salt, shard))
        x, shard, salt = x[order], shard[order], salt[order]
        cut = np.flatnonzero(np.r_[True, (shard[1:] != shard[:-1]) | (salt[1:] != salt[:-1])]) if len(x) else np.zeros(0, np.int64)
        blobs = [x[i:j].tobytes() for i, j in zip(cut, [*cut[1:], len(x)][: len(cut)], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(shard[cut], pa.int32()), pa.array(salt[cut], pa.int32()), pa.array(blobs, pa.binary())], schema=_PROBES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for b in batches:
            doc = b.column(0).to_numpy()
            data, offsets = tk.buffers(b.column(1))
            for i, _, part, at in tk.chunks(data, offsets):
                lines = Lines(part, at, min_chars)
                h1, h2 = lines.hashes(part)
                x = np.empty(len(h1), _PROBE)
                x["doc"], x["h1"], x["h2"] = doc[i + lines.row[lines.long]], h1, h2
                parts.append(x)
                held += len(x)
                if held >= _FLUSH:
                    yield flush(parts)
                    parts, held = [], 0
        if parts:
            yield flush(parts)

    return run


def _group_of(doc: np.ndarray, groups: int) -> np.ndarray:
    return (tk.mix(doc.astype(np.uint64) + tk.U64(1)) % tk.U64(groups)).astype(np.int64)


def _answer(shards: int, groups: int):
    """In a shard's group: the probes whose lines go, by group of documents."""

    def run(probes: pa.Table, index: pa.Table) -> pa.Table:
        rows = []
        if probes.num_rows and index.num_rows:
            x = np.concatenate([np.frombuffer(p.as_py(), _PROBE) for p in probes["probes"]])
            h1, h2, doc = (np.ascontiguousarray(x[c]) for c in ("h1", "h2", "doc"))
            x = np.unique(x[probe(_load(index.to_pylist()), shards, h1, h2, doc)])
            g = _group_of(x["doc"], groups)
            order = np.argsort(g, kind="stable")
            cut = np.flatnonzero(np.r_[True, g[order][1:] != g[order][:-1]]) if len(x) else np.zeros(0, np.int64)
            rows = [(int(g[order[i]]), x[order[i:j]].tobytes()) for i, j in zip(cut, [*cut[1:], len(x)][: len(cut)], strict=True)]
        return pa.table({"g": pa.array([r[0] for r in rows], pa.int64()), "gone": pa.array([r[1] for r in rows], pa.binary())})

    return run


def _groups(groups: int):
    """Adds the group of each row: by id, so that its answers find it; rows without one are spread by text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("doc_id").cast(pa.int64())
            spread = tk.row_hash(*tk.buffers(b.column("text"))) % tk.U64(groups)
            own = _group_of(ids.fill_null(0).to_numpy(zero_copy_only=False), groups)
            yield b.append_column("g", pa.array(np.where(ids.is_valid().to_numpy(zero_copy_only=False), own, spread.astype(np.int64))))

    return run


def _meet(min_chars: int, finish, group: str):
    """A group of documents and the answers for it."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        gone = np.unique(np.concatenate([np.zeros(0, _PROBE), *(np.frombuffer(x.as_py(), _PROBE) for x in answers["gone"])]))

        def dropped(h1, h2, doc):
            x = np.empty(len(h1), _PROBE)
            x["doc"], x["h1"], x["h2"] = doc, h1, h2
            return np.isin(x, gone) if len(gone) else np.zeros(len(x), bool)

        docs = docs.drop_columns([group])
        return pa.Table.from_batches(finish(_with_drops(b, min_chars, dropped) for b in docs.combine_chunks().to_batches()))

    return run


def mark_lines(docs: DataFrame, finish, schema, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, broadcast_bytes: int = BROADCAST_BYTES, shard_keys: int = SHARD_KEYS, probe_rows: int = PROBE_ROWS, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """``finish`` (a batch kernel to ``schema``) of ``docs`` (doc_id, text and any others) with ``drops``: numbers of the lines to drop, as int32s."""
    spark = docs.sparkSession
    counts = settle(line_counts(docs, min_chars, min_docs), "line-counts")
    n_keys = counts.count()
    if not n_keys:
        return docs.mapInArrow(tidied_batches(_then(_no_drops, finish)), schema)
    made, shards = build_index(counts, n_keys, shard_keys)
    index = settle(made, "line-index").select("shard", "n", "shift", "print", "keeper", "extra")
    if 26 * n_keys <= broadcast_bytes:
        rows = [r.asDict() for r in index.collect()]
        return docs.mapInArrow(tidied_batches(_then(_mark(spark.sparkContext.broadcast(rows), shards, min_chars), finish)), schema)
    # A shard's probes: those that hit, which the counts give, and its even share of the others, a line having its bytes.
    size = text_bytes(docs)
    hits = counts.groupBy(F.pmod(F.shiftright("h1", 7), F.lit(shards)).cast("int").alias("shard")).agg(F.sum("n_docs").alias("hits"))
    salted = hits.select("shard", (F.lit(1) + F.ceil((F.col("hits") + F.lit(size / (min_chars + 1) / shards)) / probe_rows)).cast("int").alias("salts"))
    salts = np.ones(shards, np.int64)
    for r in salted.collect():  # a row for each shard of SHARD_KEYS keys
        salts[r["shard"]] = r["salts"]
    groups = max(8, -(-size // group_bytes))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null")
    probes = rows.mapInArrow(tidied_batches(_send(shards, salts, min_chars)), "shard int, salt int, probes binary")
    dealt = index.join(salted, "shard").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    answers = probes.groupBy("shard", "salt").cogroup(dealt.groupBy("shard", "salt")).applyInArrow(tidied_pair(_answer(shards, groups)), "g long, gone binary")
    name = free_name(docs, "g")
    grouped = docs.mapInArrow(_named(_groups(groups), name), T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))
    return grouped.groupBy(name).cogroup(answers.withColumnRenamed("g", name).groupBy(name)).applyInArrow(tidied_pair(_meet(min_chars, finish, name)), schema)


def _named(kernel, name: str):
    """A batch kernel whose last column gets ``name``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in kernel(batches):
            yield b.rename_columns([*b.schema.names[:-1], name])

    return run


def _then(first, second):
    """Two batch kernels in one worker: chained mapInArrow steps hold a worker each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return second(first(batches))

    return run


def _apply(text: bytes, drops: bytes) -> tuple[int, int, bytes]:
    parts = text.split(b"\n")
    gone = set(np.frombuffer(drops, np.int32).tolist())
    return len(parts), len(gone), b"\n".join(x for k, x in enumerate(parts) if k not in gone) if gone else text


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        done = [_apply((t or "").encode(), d) for t, d in zip(b.column("text").to_pylist(), b.column("drops").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([x[0] for x in done], pa.int64()), pa.array([x[1] for x in done], pa.int64()), pa.array([hashlib.sha256(x[2]).hexdigest() for x in done], pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [t if not d else _apply(t.encode(), d)[2].decode() for t, d in zip(b.column("text").to_pylist(), b.column("drops").to_pylist(), strict=True)]
        b = b.set_column(b.schema.get_field_index("text"), "text", pa.array(texts, b.schema.field("text").type))
        yield b.drop_columns(["drops"])


def line_report(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, n_lines before dropping, n_dropped, kept_sha256 of the rest."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return mark_lines(own, _report, "doc_id long, n_lines long, n_dropped long, kept_sha256 string", **options)


def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text``; all columns stay, and ``n_chars``, if there, follows."""
    other, clash = free_name(docs, "drops_in"), next((c for c in docs.columns if c == "drops"), None)
    named = docs.withColumnRenamed(clash, other) if clash else docs
    out = mark_lines(named, _rewrite, named.schema, **options)
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.withColumnRenamed(other, clash) if clash else out


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
l AS (SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos FROM d),
k AS (SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.doc_id, k.pos, k.line, coalesce(c.keeper <> k.doc_id, false) AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(gone::INT) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
