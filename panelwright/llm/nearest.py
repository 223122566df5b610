"""Approximate nearest neighbours: stable projections, kd-trees, chi-square stopping.

Vectors are scaled to unit length and projected to DIMS dimensions by a Gaussian
matrix.  For two vectors at distance d, projected distance squared over d squared
is chi-square with DIMS degrees of freedom; so what lies farther, projected, than
the CONFIDENCE quantile times the distance of the k-th best is closer than that
with probability 1 - CONFIDENCE at most, and a query stops there.

1. A kd-tree fitted to the projections of at most SAMPLE_ROWS rows, taken by hash,
   cuts the projected space into parts (MAX_PARTS at most).  Every row goes to its
   part; a part of more than ``part_rows`` rows is split by id.  Of equal vectors
   only the k + 1 smallest ids can be anyone's neighbours: a task keeps no more of
   a batch, and a part's tree no more of its rows, so copies fill no part.
2. Each piece of a part is indexed by a kd-tree of its own.
3. Queries with one vector are searched once (in QUERY_SALT groups at most).  A
   query first goes to the part that is nearest to it, which gives it a k-th best;
   then to the parts whose boxes the stopping test cannot rule out.  In a tree it
   takes the leaves in the order of their projected distance, verifies their
   vectors exactly and stops by the same test.
4. Queries meet pieces in blocks of about ``query_block``; only parts' boxes and
   counts are broadcast, MAX_PARTS of them for each length of vectors.

Defined results: vectors that are null, zero or hold null or non-finite
components, and rows without an id, take no part; vectors of different lengths
are not compared; rows that share an id are one row, with the least vector; rows
with the query's id are not its neighbours; ties go to the smaller id; an empty
table, or one without queries, gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .support import settle, table, tidied, tidied_batches, tidied_pair

DIMS = 8
CONFIDENCE = 0.95
LEAF = 64
STEP = 12  # leaves verified between two tests
PART_ROWS = 8192
MAX_PARTS = 16_384
SAMPLE_ROWS = 131_072
QUERY_BLOCK = 4096
QUERY_SALT = 16
SEED = 11


def chi_square_quantile(p: float, dims: int) -> float:
    """Quantile of the chi-square law with an even number of degrees of freedom, by bisection."""
    assert dims % 2 == 0
    cdf = lambda x: 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(dims // 2))
    lo, hi = 0.0, 1.0
    while cdf(hi) < p:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return hi


def projection(length: int, dims: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64([SEED, length])).standard_normal((length, dims))


def kd_order(points: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """(order of rows by leaf, leaf offsets) of a kd-tree that halves the widest dimension."""
    order = np.arange(len(points))
    stack, cuts = [(0, len(points))], [0]
    while stack:
        i, j = stack.pop()
        if j - i <= leaf:
            cuts.append(j)
            continue
        own = order[i:j]
        p = points[own]
        widest = int(np.argmax(p.max(0) - p.min(0)))
        mid = (j - i) // 2
        order[i:j] = own[np.argpartition(p[:, widest], mid)]
        stack += [(i + mid, j), (i, i + mid)]
    return order, np.array(cuts)


def _usable(vec: str) -> F.Column:
    whole = F.coalesce(F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    return whole & F.exists(vec, lambda x: x != 0)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<double>, dim) of the rows that take part, one for each id."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.filter(F.col("vec_id").isNotNull() & _usable("v"))
    repeated = rows.groupBy("vec_id").count().filter("count > 1").select("vec_id")
    if repeated.limit(1).count():
        least = rows.join(repeated, "vec_id", "left_semi").groupBy("vec_id").agg(F.min("v").alias("v"))
        rows = rows.join(repeated, "vec_id", "left_anti").unionByName(least)
    return rows.withColumn("dim", F.size("v"))


def _stack(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    return np.concatenate([np.zeros(0), *(c.flatten().to_numpy() for c in chunks)]).reshape(-1, dim)


def unit(v: np.ndarray) -> np.ndarray:
    big = np.abs(v).max(1, keepdims=True)
    w = v / big
    return w / np.sqrt((w * w).sum(1, keepdims=True))


class Cells:
    """A kd-tree that cuts the projected space: ``dim`` (-1 at a part), ``value``, ``left`` (right is the next), ``part``."""

    def __init__(self, points: np.ndarray, parts: int):
        points = np.unique(points, axis=0)
        self.dim, self.value, self.left, self.part, self.parts = [-1], [0.0], [0], [0], 1
        # The fullest cell is split until there are enough; cells of one point stay whole.
        cells = {0: points}
        while self.parts < parts and cells:
            node = max(cells, key=lambda k: (len(cells[k]), -k))
            own = cells.pop(node)
            if len(own) < 2:
                break
            widest = int(np.argmax(own.max(0) - own.min(0)))
            x = np.sort(own[:, widest])
            value = x[len(x) // 2] if x[len(x) // 2] > x[0] else x[x > x[0]][0]
            self.dim[node], self.value[node], self.left[node] = widest, float(value), len(self.dim)
            low = own[:, widest] < value
            for k, half in enumerate((own[low], own[~low])):
                self.dim.append(-1), self.value.append(0.0), self.left.append(0)
                self.part.append(self.part[node] if k == 0 else self.parts)
                cells[len(self.dim) - 1] = half
            self.parts += 1
        self.dim, self.value, self.left, self.part = (np.array(x) for x in (self.dim, self.value, self.left, self.part))

    def of(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        at = np.flatnonzero(self.dim[node] >= 0)
        while len(at):
            n = node[at]
            node[at] = self.left[n] + (points[at, self.dim[n]] >= self.value[n])
            at = at[self.dim[node[at]] >= 0]
        return self.part[node]


def _by_length(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, their vectors) of a batch with columns dim and v."""
    dims = b.column("dim").to_numpy()
    for dim in np.unique(dims):
        rows = np.flatnonzero(dims == dim)
        yield int(dim), rows, _stack(b.column("v").take(pa.array(rows)), int(dim))


def _projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for dim, _, v in _by_length(b):
            points = unit(v) @ projection(dim, DIMS)
            yield pa.RecordBatch.from_pydict({"p": pa.array([x.tobytes() for x in points], pa.binary())})


def fit_cells(vectors: DataFrame, n: int, part_rows: int = PART_ROWS, sample_rows: int = SAMPLE_ROWS) -> Cells:
    """Parts from a sample by hash of about ``sample_rows`` rows at most."""
    share = min(1 << 30, int(sample_rows / max(n, 1) * (1 << 30)))
    some = vectors.filter(F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(1 << 30)) < share) if n > sample_rows else vectors
    rows = some.mapInArrow(tidied_batches(_projected), "p binary").collect()
    points = np.frombuffer(b"".join(bytes(r["p"]) for r in rows), "<f8").reshape(-1, DIMS)
    return Cells(points, min(MAX_PARTS, max(1, -(-n // part_rows))))


def _least_copies(ids: np.ndarray, v: np.ndarray, k: int) -> np.ndarray:
    """Rows that stay when of equal vectors only the ``k`` smallest ids do."""
    _, of = np.unique(v, axis=0, return_inverse=True)
    order = np.lexsort((ids, of.ravel()))
    s = of.ravel()[order]
    first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.zeros(0, np.int64)
    place = np.arange(len(s)) - np.repeat(first, np.diff(np.r_[first, len(s)]))
    return np.sort(order[place < k])


def _assigned(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = shared.value
        for b in batches:
            ids = b.column("vec_id").to_numpy()
            for dim, rows, v in _by_length(b):
                keep = _least_copies(ids[rows], v, k)
                part = cells.of(unit(v[keep]) @ projection(dim, DIMS))
                out = pa.array(rows[keep])
                yield pa.RecordBatch.from_arrays([b.column("vec_id").take(out), b.column("v").take(out), b.column("dim").take(out), pa.array(part, pa.int32())], names=["vec_id", "v", "dim", "part"])

    return run


_INDEX = "dim int, part int, piece int, n long, low binary, high binary, ids binary, vectors binary, cuts binary, lows binary, highs binary"


def _tree(k: int):
    def run(t: pa.Table) -> pa.Table:
        dim = t["dim"][0].as_py()
        ids, v = t["vec_id"].to_numpy(), _stack(t["v"], dim)
        keep = _least_copies(ids, v, k)
        keep = keep[np.argsort(ids[keep], kind="stable")]
        ids, v = ids[keep], v[keep]
        points = unit(v) @ projection(dim, DIMS)
        order, cuts = kd_order(points)
        points = points[order]
        low, high = np.minimum.reduceat(points, cuts[:-1]), np.maximum.reduceat(points, cuts[:-1])
        blobs = [low.min(0), high.max(0), ids[order].astype("<i8"), v[order].astype("<f8"), cuts.astype("<i8"), low, high]
        names = ("low", "high", "ids", "vectors", "cuts", "lows", "highs")
        numbers = {"dim": pa.array([dim], pa.int32()), "part": pa.array([t["part"][0].as_py()], pa.int32()), "piece": pa.array([t["piece"][0].as_py()], pa.int32()), "n": pa.array([len(ids)], pa.int64())}
        return pa.table(numbers | {c: pa.array([x.tobytes()], pa.binary()) for c, x in zip(names, blobs, strict=True)})

    return run


def build_index(vectors: DataFrame, cells: Cells, k: int, part_rows: int = PART_ROWS) -> DataFrame:
    """One row per piece of a part: its box and its kd-tree.  ``vectors``: what ``usable`` gives; ``k``: copies of a vector that stay."""
    spark = vectors.sparkSession
    dealt = settle(vectors.mapInArrow(tidied_batches(_assigned(spark.sparkContext.broadcast(cells), k)), "vec_id long, v array<double>, dim int, part int"), "kd-rows")
    # A row per part and length of vectors: bounded by MAX_PARTS for each length.
    pieces = F.broadcast(dealt.groupBy("dim", "part").agg(F.ceil(F.count(F.lit(1)) / part_rows).cast("int").alias("pieces")))
    rows = dealt.join(pieces, ["dim", "part"]).withColumn("piece", F.pmod(F.xxhash64("vec_id"), F.col("pieces")).cast("int")).drop("pieces")
    return settle(rows.groupBy("dim", "part", "piece").applyInArrow(tidied(_tree(k)), _INDEX), "kd-index")


class _Boxes:
    """The box and the number of pieces of each part, by length of vectors."""

    def __init__(self, rows):
        self.by_dim: dict[int, tuple] = {}
        found: dict[tuple, list] = {}
        for r in rows:
            low, high = np.frombuffer(r["low"], "<f8"), np.frombuffer(r["high"], "<f8")
            x = found.setdefault((r["dim"], r["part"]), [low, high])
            x[0], x[1] = np.minimum(x[0], low), np.maximum(x[1], high)
        for dim in sorted({d for d, _ in found}):
            parts = sorted(p for d, p in found if d == dim)
            self.by_dim[dim] = np.array(parts), np.array([found[dim, p][0] for p in parts]), np.array([found[dim, p][1] for p in parts])

    def far(self, dim: int, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(parts, queries x parts squared projected distances to the boxes)."""
        parts, low, high = self.by_dim[dim]
        p = unit(v) @ projection(dim, DIMS)
        out = np.empty((len(p), len(parts)))
        for i in range(len(p)):
            gap = np.maximum(np.maximum(low - p[i], p[i] - high), 0)
            out[i] = (gap * gap).sum(1)
        return parts, out


def _part_boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's pieces as one box per part."""
    rows = _Boxes([])
    for b in batches:
        rows = _Boxes([*b.select(["dim", "part", "low", "high"]).to_pylist(), *({"dim": d, "part": int(p), "low": lo.tobytes(), "high": hi.tobytes()} for d, (parts, low, high) in rows.by_dim.items() for p, lo, hi in zip(parts, low, high, strict=True))])
    out = [(d, int(p), lo.tobytes(), hi.tobytes()) for d, (parts, low, high) in rows.by_dim.items() for p, lo, hi in zip(parts, low, high, strict=True)]
    columns = list(zip(*out, strict=True)) if out else [[]] * 4
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["dim", "part", "low", "high"])


_VISITS = pa.schema([("dim", pa.int32()), ("part", pa.int32()), ("n", pa.int64()), ("reps", pa.binary()), ("least", pa.binary()), ("v", pa.binary())])
_VISIT_TYPES = "dim int, part int, n long, reps binary, least binary, v binary"


def _visits(shared, factor: float):
    """Queries packed by the part to visit: the nearest one, or (with column ``least``) the others that the test leaves open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        boxes = shared.value
        for b in batches:
            reps = b.column("rep").to_numpy()
            later = "least" in b.schema.names
            least = b.column("least").fill_null(-2.0).to_numpy(zero_copy_only=False) if later else np.full(len(reps), -2.0)
            for dim, rows, v in _by_length(b):
                if dim not in boxes.by_dim:
                    continue
                # Blocks of queries bound the memory of the distances.
                for i in range(0, len(rows), 256):
                    own, mine = rows[i : i + 256], v[i : i + 256]
                    parts, far = boxes.far(dim, mine)
                    nearest = far.argmin(1)
                    if later:
                        goes = far <= factor * np.maximum(0.0, 2 - 2 * least[own])[:, None] + 1e-9
                        goes[np.arange(len(own)), nearest] = False
                    else:
                        goes = np.zeros(far.shape, bool)
                        goes[np.arange(len(own)), nearest] = True
                    out = []
                    for p in np.flatnonzero(goes.any(0)):
                        q = np.flatnonzero(goes[:, p])
                        out.append((dim, int(parts[p]), len(q), reps[own[q]].astype("<i8").tobytes(), least[own[q]].astype("<f8").tobytes(), mine[q].astype("<f8").tobytes()))
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _VISITS, strict=True)], schema=_VISITS)

    return run


class _Best:
    """The k best of each query so far: by cosine, then smaller id; none below its floor."""

    def __init__(self, floor: np.ndarray, k: int):
        self.floor = floor
        self.score = np.full((len(floor), k), -np.inf)
        self.ids = np.full((len(floor), k), np.iinfo(np.int64).max)

    def least(self, q: int) -> float:
        return max(self.floor[q], self.score[q, -1])

    def add(self, q: int, score: np.ndarray, ids: np.ndarray) -> None:
        k = self.score.shape[1]
        own = score >= self.least(q)
        s, i = np.r_[self.score[q], score[own]], np.r_[self.ids[q], ids[own]]
        top = np.lexsort((i, -s))[:k]
        self.score[q], self.ids[q] = s[top], i[top]


def search_tree(best: _Best, queries: np.ndarray, tree: dict, factor: float) -> None:
    """Verify a tree's leaves against unit vectors ``queries`` until the stopping test holds."""
    dim = tree["dim"]
    ids = np.frombuffer(tree["ids"], "<i8")
    v = unit(np.frombuffer(tree["vectors"], "<f8").reshape(-1, dim))
    cuts = np.frombuffer(tree["cuts"], "<i8")
    low, high = (np.frombuffer(tree[k], "<f8").reshape(-1, DIMS) for k in ("lows", "highs"))
    points = queries @ projection(dim, DIMS)
    for q, (x, p) in enumerate(zip(queries, points, strict=True)):
        gap = np.maximum(np.maximum(low - p, p - high), 0)
        far = (gap * gap).sum(1)
        order = np.argsort(far, kind="stable")
        for i in range(0, len(order), STEP):
            # Squared distance of unit vectors is 2 - 2 cosine.
            if far[order[i]] > factor * max(0.0, 2 - 2 * best.least(q)) + 1e-9:
                break
            rows = np.concatenate([np.arange(cuts[k], cuts[k + 1]) for k in order[i : i + STEP]])
            # A row-wise sum: equal vectors get equal cosines, wherever they are.
            best.add(q, (v[rows] * x).sum(1), ids[rows])


def _search(k: int, factor: float):
    def run(visits: pa.Table, trees: pa.Table) -> pa.Table:
        reps, ids, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if visits.num_rows and trees.num_rows:
            (tree,) = trees.to_pylist()
            rep, floor, v = (np.concatenate([np.frombuffer(x.as_py(), kind) for x in visits[c]]) for c, kind in (("reps", "<i8"), ("least", "<f8"), ("v", "<f8")))
            best = _Best(floor, k)
            search_tree(best, unit(v.reshape(len(rep), -1)), tree, factor)
            q, j = np.nonzero(best.score > -np.inf)
            reps.append(rep[q]), ids.append(best.ids[q, j]), scores.append(best.score[q, j])
        return pa.table({"rep": np.concatenate(reps), "vec_id": np.concatenate(ids), "score": np.concatenate(scores)})

    return run


def _found(visits: DataFrame, index: DataFrame, pieces: DataFrame, k: int, factor: float, query_block: int) -> DataFrame:
    """(rep, vec_id, score): the k best of each query in the parts that it visits."""
    packs = settle(visits, "visits").withColumn("pack", F.monotonically_increasing_id())
    blocks = packs.groupBy("dim", "part").agg(F.ceil(F.sum("n") / query_block).cast("int").alias("blocks")).join(pieces, ["dim", "part"])
    # Both tables are bounded by MAX_PARTS rows for each length of vectors.
    blocks = F.broadcast(blocks)
    key = ["dim", "part", "piece", "block"]
    sent = packs.join(blocks, ["dim", "part"]).withColumn("block", F.pmod(F.xxhash64("pack"), F.col("blocks")).cast("int")).withColumn("piece", F.explode(F.expr("sequence(0, pieces - 1)")))
    trees = index.join(blocks, ["dim", "part"]).withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)"))).select(*key, "ids", "vectors", "cuts", "lows", "highs")
    return sent.select(*key, "reps", "least", "v").groupBy(*key).cogroup(trees.groupBy(*key)).applyInArrow(tidied_pair(_search(k, factor)), "rep long, vec_id long, score double")


def _best_of(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("rep").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, confidence: float = CONFIDENCE, query_block: int = QUERY_BLOCK, part_rows: int = PART_ROWS, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each query, by cosine."""
    spark = vectors.sparkSession
    own = usable(vectors)
    factor = chi_square_quantile(confidence, DIMS)
    # One neighbour more than asked for: the query may find itself.
    more = k + 1
    index = build_index(own, fit_cells(own, own.count(), part_rows, sample_rows), more, part_rows)
    pieces = index.groupBy("dim", "part").agg((F.max("piece") + 1).alias("pieces"))
    boxes = spark.sparkContext.broadcast(_Boxes(index.select("dim", "part", "low", "high").mapInArrow(_part_boxes, "dim int, part int, low binary, high binary").repartition(1).mapInArrow(_part_boxes, "dim int, part int, low binary, high binary").collect()))
    salt = F.pmod(F.xxhash64("vec_id"), F.lit(QUERY_SALT))
    asked = settle(usable(queries).withColumn("rep", F.min("vec_id").over(Window.partitionBy("v", salt))), "queries")
    reps = asked.filter("rep = vec_id").select("rep", "dim", "v")
    first = settle(_best_of(_found(reps.mapInArrow(tidied_batches(_visits(boxes, factor)), _VISIT_TYPES), index, pieces, more, factor, query_block), more), "first")
    floor = first.filter(F.col("place") == more).select("rep", F.col("score").alias("least"))
    open_ = reps.join(floor, "rep", "left")
    then = _found(open_.mapInArrow(tidied_batches(_visits(boxes, factor)), _VISIT_TYPES), index, pieces, more, factor, query_block)
    best = _best_of(first.drop("place").unionByName(then), more).groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score"))).alias("best"))
    kept = asked.select(F.col("vec_id").alias("query_id"), "rep").join(best, "rep").withColumn("best", F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("query_id")), 1, k))
    return kept.select("query_id", F.posexplode("best").alias("at", "x")).select("query_id", (F.col("at") + 1).alias("rank"), "x.vec_id", "x.score")


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter("vec_id % 50 = 0"))
