"""Quality classifier: random Fourier features, ridge from partition sums, isotonic calibration.

One pass turns each text into about thirty statistics.  The rest works on them:
partitions sum the normal equations of a ridge regression on random Fourier
features (a Gaussian kernel, approximately), the driver solves them, and a part
of the labelled rows kept from the fit calibrates the scores by pooling adjacent
violators on a histogram of raw scores.  At most ``MAX_LABELLED`` labelled rows,
chosen by a hash of the id, take part; every document is scored.

Defined results: null and empty texts are scored from their (zero) statistics;
rows are scored one by one, repeated or not; labels other than 0 and 1 and rows
without an id are not learned from; conflicting labels of one id are averaged;
with no labels every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .support import held_out, partition_sums, settle, table, tidied_batches

MAX_LABELLED = 80_000
FEATURES = 384
RIDGE = 1e-4
BINS = 4096
SEED = 7

# Byte classes of the statistics.
_CLASS = np.full(256, 12, np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 0, 1, 2, 3
for _k, _bytes in enumerate((b" \t\r\x0b\x0c", b"\n", b".,;:", b"!?", b"#$%&*", b"|", b"'\"()", b"/\\@=_-+~^<>"), 4):
    _CLASS[list(_bytes)] = _k
_N_CLASS = 13
N_STATS = _N_CLASS + 19


def _repeat_share(h: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row: distinct values over values, and the share of the most frequent one."""
    total = np.bincount(row, minlength=n)
    order = np.lexsort((h, row))
    a, r = h[order], row[order]
    first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (r[1:] != r[:-1])]) if len(a) else np.zeros(0, np.int64)
    held = np.diff(np.r_[first, len(a)])
    distinct = np.bincount(r[first], minlength=n)
    top = np.zeros(n)
    np.maximum.at(top, r[first], held)
    return distinct / np.maximum(total, 1), top / np.maximum(total, 1)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows x N_STATS statistics of texts; all finite, zero where there is nothing to count."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    row = np.repeat(np.arange(n), size)
    per = 1 / np.maximum(size, 1)
    out = np.zeros((n, N_STATS))
    bytes_of = np.bincount(row * 256 + data, minlength=256 * n).reshape(n, 256)
    out[:, :_N_CLASS] = np.stack([bytes_of[:, _CLASS == k].sum(1) for k in range(_N_CLASS)], 1) * per[:, None]
    p = bytes_of * per[:, None]
    k = _N_CLASS
    out[:, k] = -(p * np.log2(np.where(p > 0, p, 1))).sum(1)
    w = tk.Words(data, offsets)
    count, length = w.counts, w.ends - w.starts
    of = np.repeat(np.arange(n), count)
    each = 1 / np.maximum(count, 1)
    total = lambda x: np.bincount(of, weights=x, minlength=n)
    mean = total(length) * each
    out[:, k + 1] = mean
    out[:, k + 2] = np.sqrt(np.maximum(total(length.astype(float) ** 2) * each - mean**2, 0))
    if len(length):
        head, tail = _CLASS[data[w.starts]], _CLASS[data[w.ends - 1]]
        out[:, k + 3] = total(length <= 3) * each
        out[:, k + 4] = total(length >= 14) * each
        out[:, k + 5] = total(head == 1) * each
        out[:, k + 6] = total((tail >= 6) & (tail != 12)) * each
        out[:, k + 7] = total((tail == 8) | (head == 8)) * each
        out[:, k + 8] = total(tail == 7) * each
        out[:, k + 9] = total((length == 1) & (head == 9)) * each
        same = np.zeros(len(of))
        same[1:] = (w.hashes[1:] == w.hashes[:-1]) & (of[1:] == of[:-1])
        out[:, k + 10] = total(same) * each
        out[:, k + 11], out[:, k + 12] = _repeat_share(w.hashes, of, n)
        sh, of3 = w.shingles(3)
        out[:, k + 13], out[:, k + 14] = _repeat_share(sh, of3, n)
    lines = bytes_of[:, 10] + 1
    out[:, k + 15] = np.log1p(size)
    out[:, k + 16] = np.log1p(count)
    out[:, k + 17] = np.log1p(count / lines)
    out[:, k + 18] = np.log1p(lines)
    return out


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, offsets = tk.buffers(b.column("text"))
        parts = [statistics(part, at) for _, _, part, at in tk.chunks(data, offsets)]
        flat = np.concatenate([np.zeros((0, N_STATS)), *parts]).astype("<f4")
        blobs = pa.array([x.tobytes() for x in flat], pa.binary())
        yield b.drop_columns(["text"]).append_column("stats", blobs)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    knots: tuple[np.ndarray, np.ndarray] | None = None

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -5, 5)
        rng = np.random.Generator(np.random.PCG64(SEED))
        d = z.shape[1]
        w = rng.standard_normal((d, FEATURES)) / np.sqrt(d)
        phase = rng.uniform(0, 2 * np.pi, FEATURES)
        return np.concatenate([np.sqrt(2 / FEATURES) * np.cos(z @ w + phase), np.ones((len(z), 1))], axis=1)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weight

    def score(self, stats: np.ndarray) -> np.ndarray:
        raw = self.raw(stats)
        if self.knots is None:
            return np.full(len(stats), 0.5)
        # A slight slope keeps the order of raw scores on the flat steps.
        return np.clip(np.interp(raw, *self.knots) * 0.998 + 0.002 * np.clip(raw, 0, 1), 0, 1)


def _matrix(column: pa.Array) -> np.ndarray:
    data, _ = tk.buffers(column)
    return np.frombuffer(data.tobytes(), "<f4").reshape(len(column), -1).astype(float)


def _blobs(rows: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"key": pa.array(list(rows), pa.string()), "blob": pa.array([np.ascontiguousarray(v, "<f8").tobytes() for v in rows.values()], pa.binary())})


def _summed(of):
    """One row of sums for each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for i in range(0, b.num_rows, 2048):
                part = b.slice(i, 2048)
                for k, v in of(_matrix(part.column("stats")), part.column("y").to_numpy(), part.column("calibrates").to_numpy(zero_copy_only=False)).items():
                    sums[k] = sums[k] + v if k in sums else v
        if sums:
            yield _blobs(sums)

    return run


def pool_violators(y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Isotonic (nondecreasing) weighted least squares fit."""
    value, weight, width = [], [], []
    for a, b in zip(y.tolist(), w.tolist(), strict=True):
        value.append(a), weight.append(b), width.append(1)
        while len(value) > 1 and value[-2] >= value[-1]:
            b1, b0 = weight.pop(), weight.pop()
            a1, a0 = value.pop(), value.pop()
            value.append((a0 * b0 + a1 * b1) / (b0 + b1)), weight.append(b0 + b1)
            width[-2:] = [width[-2] + width[-1]]
    return np.repeat(value, width)


def fit(train: DataFrame) -> Model:
    """``train``: stats binary, y double, calibrates boolean."""
    schema = "key string, blob binary"
    moments = partition_sums(train.mapInArrow(_summed(lambda x, y, c: {"m": np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)])}), schema), "<f8")
    if not moments:
        return Model(np.zeros(N_STATS), np.ones(N_STATS), np.zeros(FEATURES + 1))
    m = moments["m"]
    mean = m[1 : N_STATS + 1] / m[0]
    scale = np.sqrt(np.maximum(m[N_STATS + 1 :] / m[0] - mean**2, 0))
    model = Model(mean, np.where(scale > 1e-9, scale, 1.0), np.zeros(FEATURES + 1))

    def normal(x, y, calibrates):
        z, y = model.features(x[~calibrates]), y[~calibrates]
        return {"a": (z.T @ z).ravel(), "b": z.T @ y, "n": np.array([float(len(y))])}

    sums = partition_sums(train.mapInArrow(_summed(normal), schema), "<f8")
    a = sums["a"].reshape(FEATURES + 1, FEATURES + 1)
    model.weight = np.linalg.solve(a + RIDGE * max(1.0, sums["n"][0]) * np.eye(FEATURES + 1), sums["b"])

    def histogram(x, y, calibrates):
        raw = np.clip(model.raw(x[calibrates]), -0.5, 1.5)
        k = np.minimum(((raw + 0.5) / 2 * BINS).astype(np.int64), BINS - 1)
        return {n: np.bincount(k, weights=v, minlength=BINS) for n, v in (("n", np.ones(len(k))), ("x", raw), ("y", y[calibrates]))}

    h = partition_sums(train.mapInArrow(_summed(histogram), schema), "<f8")
    full = h["n"] > 0
    if full.any():
        n, x, y = (h[k][full] for k in ("n", "x", "y"))
        model.knots = (x / n, pool_violators(y / n, n))
    else:
        model.knots = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    return model


def _scored(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            parts = [model.score(_matrix(b.column("stats").slice(i, 2048))) for i in range(0, b.num_rows, 2048)]
            yield b.drop_columns(["stats"]).append_column("score", pa.array(np.concatenate([np.zeros(0), *parts])))

    return run


def score_quality(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted.  Rows held out are not learned from."""
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    stats = settle(own.mapInArrow(tidied_batches(_stats), "doc_id long, held_out boolean, stats binary"), "quality-stats")
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y")).filter("y in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.avg("y").alias("y"))
    known = marks.filter(~held_out())
    n = known.count()
    if n > max_labelled:
        known = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 30)) < int(max_labelled / n * (1 << 30)))
    train = stats.join(known, "doc_id").select("stats", "y", (F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(4)) == 0).alias("calibrates"))
    model = fit(settle(train, "quality-train"))
    scored = stats.mapInArrow(_scored(spark.sparkContext.broadcast(model)), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
