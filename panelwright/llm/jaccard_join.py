"""N-gram Jaccard join by token-combination prefixes.

Tokens are distinct five-word shingles.  The global order runs from rare to
frequent, by the logarithm of the number of documents and then by hash.

1. Documents send their tokens, packed, to buckets of the token space; a bucket
   counts documents per token and returns to each document only its tokens that
   some other document has, with their frequency class.  A document's other
   tokens are unique: they matter by number alone, since the Jaccard similarity
   needs the two set sizes and the common tokens.
2. With J >= t, at most n - ceil(t n) =: a tokens of a set of n are missing from
   its partner.  A set with more than a unique tokens has no partner.  Otherwise
   its prefix is its first a + 1 tokens below the frequent class (unique ones
   first), and each that is not unique is indexed alone: the least common such
   token lies in both prefixes.  If even all of these are no more than a, the
   pair may have only frequent tokens in common; then the prefix is extended into
   the frequent class and combinations of k = 2 tokens adjacent in the order are
   indexed.  A missing token breaks two adjacencies and an extra one breaks one,
   at most 2n/5 in all for t = 4/5, so one of the first 2n/5 + 1 is in common
   (the code takes the exact maximum over the allowed numbers of both).
   Combinations are linear in n, and a hot passage's single tokens index nothing.
3. Documents that share an index entry are candidates; their closure under
   candidacy (entries link each holder to the least one, so rows stay linear)
   is solved exactly, by overlap counts over the tokens, skipping pairs already
   connected.  Of documents with one set that meet in a task of step 2 only the
   least goes on.  A closure above ``TASK_TOKENS`` is cut into blocks.  Each block
   first meets ``PIVOTS`` documents of the closure, which joins a large group of
   copies in linear work; then blocks meet in pairs, but for two of one group
   that is already joined.

Defined results: null, empty or wordless texts have size 0 and their own id as
component; rows without an id get no component; rows that share an id count as
one document, the one with the least text, and each such row is returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textkit as tk
from .components import connected_components
from .support import free_name, settle, table, text_bytes, tidied, tidied_batches

WORDS = 5
PERCENT = 80
BUCKET_BYTES = 8 << 20
SEND_BYTES = 3 << 20
TASK_TOKENS = 4_000_000
BROADCAST_ROWS = 1_000_000
PIVOTS = 16
FREQUENT = 7  # class floor(log2(documents)) from which tokens are indexed in combinations
_NAME = tk.U64((1 << 48) - 1)
_KEYS = "key int, kind int, docs binary, counts binary, names binary, classes binary"
_ARROW = pa.schema([("key", pa.int32()), ("kind", pa.int32()), ("docs", pa.binary()), ("counts", pa.binary()), ("names", pa.binary()), ("classes", pa.binary())])
_SIZES, _TOKENS = 0, 1


def one_row_per_id(docs: DataFrame) -> tuple[DataFrame, bool]:
    """(doc_id, text) with one row for each id that is not null: of rows that share an id, the least text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null")
    repeated = docs.groupBy("doc_id").count().filter("count > 1").select("doc_id")
    if not repeated.limit(1).count():
        return docs, False
    least = docs.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    return docs.join(repeated, "doc_id", "left_anti").unionByName(least), True


def _pack6(names: np.ndarray) -> bytes:
    return np.ascontiguousarray(names.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpack6(blob: bytes) -> np.ndarray:
    six = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    out = np.zeros((len(six), 8), np.uint8)
    out[:, :6] = six
    return out.view("<u8").ravel()


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> tk.U64(48)) * tk.U64(buckets) >> tk.U64(16)).astype(np.int64)


def _group(doc: np.ndarray, groups: int) -> np.ndarray:
    return (tk.mix(doc.astype(np.uint64)) % tk.U64(groups)).astype(np.int64)


def _cut(key: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple]:
    """The arrays' pieces for each value of ``key``, order kept inside."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    at = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
    arrays = [a[order] for a in arrays]
    for i, j in zip(at, [*at[1:], len(k)][: len(at)], strict=True):
        yield int(k[i]), *(a[i:j] for a in arrays)


def _by_doc(doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a grouped array, and their run lengths."""
    at = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    return doc[at], np.diff(np.r_[at, len(doc)])


def _row(key: int, kind: int, docs: np.ndarray, counts: np.ndarray, names: bytes = b"", classes: bytes = b"") -> dict:
    return {"key": key, "kind": kind, "docs": docs.astype(np.int64).tobytes(), "counts": counts.astype(np.uint32).tobytes(), "names": names, "classes": classes}


def shingle_sets(ids: np.ndarray, data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(distinct shingle hashes, document id of each, set size of each row) chunk by chunk; rows' hashes ascend."""
    for i, j, part, at in tk.chunks(data, offsets, SEND_BYTES):
        sh, row = tk.Words(part, at).shingles(words)
        order = np.lexsort((sh, row))
        sh, row = sh[order], row[order]
        new = np.r_[True, (sh[1:] != sh[:-1]) | (row[1:] != row[:-1])] if len(sh) else np.zeros(0, bool)
        sh, row = sh[new], row[new]
        yield sh, ids[i + row], np.bincount(row, minlength=j - i)


def _send(buckets: int, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            if not len(ids):
                continue
            sizes = []
            for token, doc, size in shingle_sets(ids, *tk.buffers(b.column(1)), words):
                sizes.append(size)
                if len(token):
                    yield pa.RecordBatch.from_pylist([_row(k, _TOKENS, *_by_doc(d), _pack6(t & _NAME)) for k, t, d in _cut(_bucket(token, buckets), token, doc)], schema=_ARROW)
            yield pa.RecordBatch.from_pylist([_row(-1 - int(tk.mix(ids[:1].astype(np.uint64))[0] % tk.U64(buckets)), _SIZES, ids, np.concatenate(sizes))], schema=_ARROW)

    return run


def _count(groups: int):
    """In a bucket: the tokens that two documents or more have, back to the documents."""

    def run(t: pa.Table) -> pa.Table:
        rows = []
        if t["kind"][0].as_py() == _SIZES:
            for r in t.to_pylist():
                docs, size = np.frombuffer(r["docs"], np.int64), np.frombuffer(r["counts"], np.uint32)
                rows += [_row(g, _SIZES, d, n) for g, d, n in _cut(_group(docs, groups), docs, size)]
            return pa.Table.from_pylist(rows, schema=_ARROW)
        key = tk.U64(t["key"][0].as_py())
        name = np.concatenate([_unpack6(x.as_py()) for x in t["names"]])
        doc = np.concatenate([np.repeat(np.frombuffer(d.as_py(), np.int64), np.frombuffer(c.as_py(), np.uint32)) for d, c in zip(t["docs"], t["counts"], strict=True)])
        order = np.argsort(name, kind="stable")
        s = name[order]
        first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        held = np.diff(np.r_[first, len(s)])
        classes = np.empty(len(s), np.uint8)
        classes[order] = np.repeat(np.floor(np.log2(held)).astype(np.uint8), held)
        some = classes > 0
        name, doc, classes = name[some] | (key << tk.U64(48)), doc[some], classes[some]
        order = np.argsort(doc, kind="stable")
        name, doc, classes = name[order], doc[order], classes[order]
        for g, n, d, c in _cut(_group(doc, groups), name, doc, classes):
            rows.append(_row(g, _TOKENS, *_by_doc(d), n.tobytes(), c.tobytes()))
        return pa.Table.from_pylist(rows, schema=_ARROW)

    return run


def prefix_entries(n: int, tokens: np.ndarray, classes: np.ndarray, percent: int = PERCENT, frequent: int = FREQUENT) -> np.ndarray | None:
    """Index entries of a set of ``n`` tokens whose shared ones come in the global order; None if it can have no partner."""
    allowed = n - -(-percent * n // 100)
    unique = n - len(tokens)
    if unique > allowed or not n:
        return None
    cut = int(np.searchsorted(classes, frequent))
    need = allowed + 1 - unique
    if cut >= need:
        return tokens[:need]
    often = tokens[cut:]
    if len(often) < 2:
        return tokens
    # At most 2 * missing + extra adjacencies are broken.  With m missing, 100 * (n - m) // percent - n are extra at most;
    # for each more that is missing that falls by the whole numbers around 100 / percent, so one end of m is the maximum.
    broken = max(2 * m + 100 * (n - m) // percent - n for m in (0, allowed))
    pairs = min(len(often) - 1, broken + 1)
    with np.errstate(over="ignore"):
        return np.concatenate([tokens[:cut], tk.mix(often[:pairs] * tk.U64(tk._BASE) + often[1 : pairs + 1])])


_SETS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("tokens", pa.binary()), ("entries", pa.list_(pa.int64())), ("same", pa.int64())])
_SETS_DDL = "doc_id long, n long, tokens binary, entries array<long>, same long"


def _assemble(percent: int, frequent: int):
    """In a group of documents: each one's size, shared tokens in order and index entries.

    A set that the group has already is left to its least document, which ``same`` names.
    """

    def run(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        sized = [r for r in rows if r["kind"] == _SIZES]
        ids = np.concatenate([np.frombuffer(r["docs"], np.int64) for r in sized])
        size = np.concatenate([np.frombuffer(r["counts"], np.uint32) for r in sized]).astype(np.int64)
        rows = [r for r in rows if r["kind"] == _TOKENS]
        if rows:
            doc = np.concatenate([np.repeat(np.frombuffer(r["docs"], np.int64), np.frombuffer(r["counts"], np.uint32)) for r in rows])
            token = np.concatenate([np.frombuffer(r["names"], np.uint64) for r in rows])
            classes = np.concatenate([np.frombuffer(r["classes"], np.uint8) for r in rows])
            order = np.lexsort((token, classes, doc))
            doc, token, classes = doc[order], token[order], classes[order]
        else:
            doc, token, classes = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint8)
        order = np.argsort(ids)
        ids, size = ids[order], size[order]
        lo, hi = np.searchsorted(doc, ids), np.searchsorted(doc, ids, "right")
        tokens, entries, same, first = [], [], [], {}
        for doc_id, n, i, j in zip(ids.tolist(), size.tolist(), lo.tolist(), hi.tolist(), strict=True):
            blob = token[i:j].tobytes()
            least = first.setdefault(blob, doc_id) if 0 < n == j - i else doc_id
            got = prefix_entries(n, token[i:j], classes[i:j], percent, frequent) if i < j and least == doc_id else None
            tokens.append(None if got is None else blob)
            entries.append(None if got is None else got.view(np.int64))
            same.append(None if least == doc_id else least)
        return pa.table([pa.array(ids), pa.array(size), pa.array(tokens, pa.binary()), pa.array(entries, pa.list_(pa.int64())), pa.array(same, pa.int64())], schema=_SETS)

    return run


def _distinct_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    own = a != b
    a, b = a[own], b[own]
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(a) else np.zeros(0, bool)
    return a[new], b[new]


def _least_of(entry: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct entries, least document of each, and pairs that link each holder to it)."""
    order = np.lexsort((doc, entry))
    e, d = entry[order], doc[order]
    first = np.flatnonzero(np.r_[True, e[1:] != e[:-1]]) if len(e) else np.zeros(0, np.int64)
    least = np.repeat(d[first], np.diff(np.r_[first, len(e)]))
    return e[first], d[first], *_distinct_pairs(d, least)


_STARS = pa.schema([("bucket", pa.int32()), ("entries", pa.binary()), ("docs", pa.binary()), ("a", pa.binary()), ("b", pa.binary())])
_FLUSH = 2_000_000


def _local_stars(buckets: int):
    """Entries of a partition: each once, with its least document; other holders are linked to that here."""

    def flush(parts: list) -> pa.RecordBatch:
        entry, doc = (np.concatenate(x) for x in zip(*parts, strict=True))
        entry, doc, a, b = _least_of(entry, doc)
        rows = [{"bucket": k, "entries": e.tobytes(), "docs": d.tobytes()} for k, e, d in _cut(_bucket(entry.view(np.uint64), buckets), entry, doc)]
        if len(a):
            rows.append({"bucket": int(a[0] % buckets), "a": a.tobytes(), "b": b.tobytes()})
        return pa.RecordBatch.from_pylist(rows, schema=_STARS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for b in batches:
            lists = b.column("entries")
            parts.append((lists.flatten().to_numpy(), np.repeat(b.column("doc_id").to_numpy(), np.diff(lists.offsets.to_numpy()))))
            held += len(parts[-1][0])
            if held >= _FLUSH:
                yield flush(parts)
                parts, held = [], 0
        if parts:
            yield flush(parts)

    return run


def _stars(t: pa.Table) -> pa.Table:
    """In a bucket of entries: links of the least documents of partitions to the least of all."""
    blobs = {c: [np.frombuffer(x, np.int64) for x in t[c].to_pylist() if x] for c in ("entries", "docs", "a", "b")}
    one = lambda c: np.concatenate([np.zeros(0, np.int64), *blobs[c]])
    *_, a, b = _least_of(one("entries"), one("docs"))
    a, b = _distinct_pairs(np.r_[a, one("a")], np.r_[b, one("b")])
    return pa.table({"a": a, "b": b})


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of a partition's pairs, each node pointing at its tree's least node."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not parts:
        return
    a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
    nodes, at = np.unique(np.r_[a, b], return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        while (new[new] != new).any():
            new = new[new]
        new = new[root]
        if (new == root).all():
            break
        root = new
    own = root != np.arange(len(nodes))
    yield pa.RecordBatch.from_pydict({"a": nodes[own], "b": nodes[root[own]]})


class _Forest:
    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: int, others: np.ndarray) -> None:
        roots = np.unique(self.root[np.r_[a, others]])
        self.root[np.isin(self.root, roots[1:])] = roots[0]


def link_sets(size: np.ndarray, at: np.ndarray, token: np.ndarray, percent: int = PERCENT, known: np.ndarray | None = None) -> np.ndarray:
    """Component label of each set under links of Jaccard >= percent/100; sets of one ``known`` label are connected.

    ``token[at[i]:at[i+1]]`` are the tokens of set i that others have too.  Sets
    are taken from the one with the largest shared part on, each against those
    after it not yet connected to it.
    """
    m = len(size)
    _, token = np.unique(token, return_inverse=True)
    mark = np.zeros(int(token.max(initial=-1)) + 1, bool)
    shared = np.diff(at)
    order = np.argsort(-(shared / np.maximum(size, 1)), kind="stable")
    place = np.empty(m, np.int64)
    place[order] = np.arange(m)
    forest = _Forest(m)
    if known is not None:
        _, first, group = np.unique(known, return_index=True, return_inverse=True)
        forest.root = first[group]
    for k, a in enumerate(order[:-1]):
        c = order[k + 1 :]
        c = c[forest.root[c] != forest.root[a]]
        if not len(c):
            if (forest.root == forest.root[0]).all():
                break
            continue
        most = np.minimum(shared[a], shared[c])
        c = c[100 * most >= percent * (size[a] + size[c] - most)]
        if not len(c):
            continue
        mark[token[at[a] : at[a + 1]]] = True
        length = shared[c]
        ends = np.cumsum(length)
        hits = np.concatenate([[0], np.cumsum(mark[token[np.repeat(at[c] - (ends - length), length) + np.arange(ends[-1])]])])
        common = hits[ends] - hits[ends - length]
        mark[token[at[a] : at[a + 1]]] = False
        linked = c[100 * common >= percent * (size[a] + size[c] - common)]
        if len(linked):
            forest.join(a, linked)
    return forest.root


def _solve(percent: int):
    """In a task: links inside each closure, as (document, least document of its part)."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("closure", "ascending"), ("doc_id", "ascending")])
        ids, closure, size = (t[c].to_numpy() for c in ("doc_id", "closure", "n"))
        known = t["root"].to_numpy() if "root" in t.column_names else ids
        blobs = t["tokens"].combine_chunks() if t["tokens"].num_chunks != 1 else t["tokens"].chunk(0)
        data, offsets = tk.buffers(blobs)
        token, at = np.frombuffer(data.tobytes(), np.uint64), offsets // 8
        label = np.empty(len(ids), np.int64)
        cuts = np.flatnonzero(np.r_[True, closure[1:] != closure[:-1]])
        for i, j in zip(cuts, [*cuts[1:], len(ids)][: len(cuts)], strict=True):
            root = link_sets(size[i:j], at[i : j + 1] - at[i], token[at[i] : at[j]], percent, known[i:j])
            label[i:j] = ids[i:j][root]
        return pa.table({"a": pa.array(ids), "b": pa.array(label)})

    return run


def jaccard_sets(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, bucket_bytes: int = BUCKET_BYTES, frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, n, tokens, entries, same) of documents with distinct ids; tokens and entries null where no partner is
    possible or ``same`` names a document with the same set."""
    buckets = max(8, -(-text_bytes(docs) // bucket_bytes))
    sent = docs.select("doc_id", "text").mapInArrow(tidied_batches(_send(buckets, words)), _KEYS)
    counted = sent.groupBy("key").applyInArrow(tidied(_count(buckets)), _KEYS)
    return settle(counted.groupBy("key").applyInArrow(tidied(_assemble(percent, frequent)), _SETS_DDL), "sets")


_LINKS = "a long, b long"


def _large_links(large: DataFrame, percent: int, task_tokens: int, total: int) -> DataFrame:
    """Links inside closures too large for a task: with a few pivots first, then between blocks not yet of one group.

    A group of copies that holds a third of all rows is joined by the pivots, so its blocks do not meet each other;
    what the pivots leave apart is compared block by block, so no link is lost.
    """
    bounded = F.broadcast if total // task_tokens <= BROADCAST_ROWS else (lambda t: t)
    number = F.row_number().over(Window.partitionBy("closure").orderBy(F.xxhash64("doc_id"), "doc_id"))
    pivots = large.select("doc_id", "n", "tokens", "closure", "blocks").withColumn("k", number).filter(F.col("k") <= PIVOTS).withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)")))
    block = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    columns = ["doc_id", "n", "tokens", "closure", "block"]
    first = large.withColumn("block", block).select(*columns).unionByName(pivots.select(*columns)).dropDuplicates(["closure", "block", "doc_id"])
    joined = settle(first.groupBy("closure", "block").applyInArrow(tidied(_solve(percent)), _LINKS).filter("a <> b").distinct(), "pivot-links")
    roots = settle(connected_components(joined, "a", "b"), "pivot-groups").withColumnsRenamed({"node": "doc_id", "component": "root"})
    member = settle(large.select("doc_id", "closure", F.expr("octet_length(tokens) div 8").alias("load")).join(roots, "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id")), "pivot-members")
    # Groups above half a task's tokens are parts of their own, 2 * total / task_tokens at most; the rest of a closure is one part.
    groups = member.groupBy("closure", "root").agg(F.sum("load").alias("load"))
    parts = settle(groups.withColumn("part", F.when(F.col("load") * 2 > task_tokens, F.col("root"))).groupBy("closure", "part").agg(F.sum("load").alias("load")), "parts")
    parts = parts.withColumn("pieces", F.ceil(F.col("load") * 2 / task_tokens).cast("int"))
    own = bounded(parts.filter("part is not null").select("closure", F.col("part").alias("root"), F.col("pieces").alias("own_pieces")))
    rest = bounded(parts.filter("part is null").select("closure", F.col("pieces").alias("rest_pieces")))
    pieces = F.coalesce("own_pieces", "rest_pieces")
    placed = member.join(own, ["closure", "root"], "left").join(rest, "closure", "left").select("doc_id", "root", F.when(F.col("own_pieces").isNotNull(), F.col("root")).alias("part"), F.pmod(F.xxhash64("doc_id"), pieces).cast("int").alias("piece"))
    blocks = parts.select("closure", "part", F.explode(F.expr("sequence(0, pieces - 1)")).alias("piece"))
    x, y = (blocks.select("closure", F.col("part").alias(f"part_{k}"), F.col("piece").alias(f"piece_{k}"), F.concat_ws("/", F.coalesce(F.col("part").cast("string"), F.lit("-")), "piece").alias(k)) for k in "xy")
    met = x.join(y, "closure").filter("x <= y and (part_x is null or part_y is null or part_x <> part_y)").withColumn("task", F.concat_ws(" ", F.col("closure").cast("string"), "x", "y"))
    sides = [met.select("closure", F.col(f"part_{k}").alias("part"), F.col(f"piece_{k}").alias("piece"), "task") for k in "xy"]
    tasks = settle(sides[0].unionByName(sides[1]).distinct(), "block-pairs")
    cells = large.select("doc_id", "n", "tokens", "closure").join(placed, "doc_id").alias("m").join(tasks.alias("t"), F.expr("m.closure = t.closure and m.part <=> t.part and m.piece = t.piece")).select("m.doc_id", "m.n", "m.tokens", "m.closure", "m.root", "t.task")
    return cells.groupBy("task").applyInArrow(tidied(_solve(percent)), _LINKS).unionByName(joined)


def jaccard_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, task_tokens: int = TASK_TOKENS, **options) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (least id reachable by links, itself included)."""
    unique, repeats = one_row_per_id(docs)
    sets = jaccard_sets(unique, words, percent, **options)
    buckets = max(8, -(-text_bytes(unique) // options.get("bucket_bytes", BUCKET_BYTES)))
    stars = sets.filter("entries is not null").select("doc_id", "entries").mapInArrow(tidied_batches(_local_stars(buckets)), "bucket int, entries binary, docs binary, a binary, b binary")
    # Pairs are thinned to a forest where they were made, before any of them is shuffled again.
    candidates = settle(stars.groupBy("bucket").applyInArrow(tidied(_stars), "a long, b long").repartition(buckets, "a").mapInArrow(tidied_batches(_forest), "a long, b long"), "candidates")
    closures = settle(connected_components(candidates, "a", "b"), "closures").withColumnsRenamed({"node": "doc_id", "component": "closure"})
    # Closures are looked up by broadcast while they are few; beyond BROADCAST_ROWS the join shuffles.
    named = F.broadcast(closures) if closures.count() <= BROADCAST_ROWS else closures
    members = sets.filter("entries is not null")
    tasks = members.select("doc_id", "n", "tokens").join(named, "doc_id")
    sizes = settle(members.select("doc_id", F.expr("octet_length(tokens) div 8").alias("load")).join(named, "doc_id").groupBy("closure").agg(F.sum("load").alias("load")), "closure-sizes")
    total = sizes.agg(F.coalesce(F.sum("load"), F.lit(0)).alias("t"), F.coalesce(F.max("load"), F.lit(0)).alias("m")).first()
    bins = max(1, -(-4 * int(total["t"]) // task_tokens))
    large_ones = sizes.filter(F.col("load") > task_tokens).withColumn("blocks", F.ceil(F.col("load") * 2 / task_tokens).cast("int"))
    # Each closure above the bound has more than task_tokens tokens, so there are total / task_tokens of them at most.
    if int(total["t"]) // task_tokens <= BROADCAST_ROWS:
        large_ones = F.broadcast(large_ones)
    small = tasks.join(large_ones, "closure", "left_anti").withColumn("task", F.pmod(F.xxhash64("closure"), F.lit(bins)).cast("string"))
    links = small.groupBy("task").applyInArrow(tidied(_solve(percent)), _LINKS)
    if total["m"] > task_tokens:
        large = tasks.join(large_ones.select("closure", "blocks"), "closure")
        links = links.unionByName(_large_links(large, percent, task_tokens, int(total["t"])))
        found = connected_components(settle(links.filter("a <> b").distinct(), "links"), "a", "b").withColumnsRenamed({"node": "a", "component": "component_id"})
    else:
        found = links.withColumnRenamed("b", "component_id")
    out = sets.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("same", "doc_id").alias("a")).join(found, "a", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "a").alias("component_id"))
    if repeats:
        out = docs.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null").join(out, "doc_id")
    nameless = docs.filter("doc_id is null").select(F.lit(None).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return out.unionByName(nameless.mapInArrow(_sizes_only(words), "doc_id long, n_shingles long, component_id long"))


def _sizes_only(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            none = pa.nulls(b.num_rows, pa.int64())
            sizes = [p[2] for p in shingle_sets(np.zeros(b.num_rows, np.int64), *tk.buffers(b.column(1)), words)]
            yield pa.RecordBatch.from_arrays([none, pa.array(np.concatenate([np.zeros(0, np.int64), *sizes])), none], names=["doc_id", "n_shingles", "component_id"])

    return run


def drop_near_copies(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without all but the least id of each component; rows without an id stay."""
    found = jaccard_components(docs, **options)
    name = free_name(docs, "gone")
    gone = found.filter("component_id <> doc_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col(name), "left_anti")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
