"""Secret scans: base rules, and a character convolutional network over every candidate.

Candidates are the base rules' matches and all other maximal runs of at least
CANDIDATE key characters that hold a letter or a digit.  A network reads each
candidate whole, with CONTEXT bytes on either side: character embeddings folded
into the filters of one convolution, a maximum over the candidate and one over
its surroundings, and a logistic output.  It is trained here, on all candidates of
all texts, of any number and length, and on fixed generated examples of both
kinds; candidates that are equal with their surroundings count once.  Base matches
are labelled secret.  What no base rule matches is not labelled: a first network,
trained without it, takes out what looks like a secret, and all the rest counts as
none (reliable negatives).

The findings are dealt by hash into shards of about SHARD.  In each of EPOCHS
passes every shard trains on its findings and the generated examples, from the same
weights, and the weights are averaged.  A quarter of the findings, by hash, and every
fourth generated example are kept from the training; all of these calibrate the
outputs (Platt, both classes weighed alike) and set the threshold, the largest that
still finds RECALL of the kept secrets of the corpus and of the generated ones, each
by themselves, as the few generated would not count among many.  Sums over shards
are in whole numbers, so neither partitions nor their order change the network.
Candidates at or above the threshold that overlap no base match are added as kind
``model``; base matches always stay.

Defined results: null texts are empty; offsets are code points, ends exclusive;
spans are whole matches; rows are scanned one by one, repeated or not; equal
starts are ordered by kind, as listed in KINDS; ``best_score`` is the network's
highest probability among a row's candidates, base ones too, null without any.
"""

from __future__ import annotations

import hashlib
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .support import partition_sums, settle, table, tidied_batches

# The base rules.
KINDS = ("assign", "access", "hex", "model")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")
ASSIGN_MIN, ACCESS_MIN, HEX_MIN = 8, 16, 32

CANDIDATE = 16
CONTEXT = 24
SHARD, SHARD_BYTES = 4096, 4 << 20
RECALL = 0.98
FILTERS, WIDTH = 24, 5
EPOCHS = 12
SEED = 5

_HEX = np.zeros(256, bool)
_HEX[48:58] = _HEX[97:103] = True
_UPPER = np.zeros(256, bool)
_UPPER[48:58] = _UPPER[65:91] = True
_KEY = np.zeros(256, bool)
_KEY[48:58] = _KEY[65:91] = _KEY[97:123] = _KEY[list(b"+/_.=-")] = True
_SOLID = _KEY.copy()
_SOLID[list(b"+/_.=-")] = False

# Character codes of the network: printable ASCII one by one, 95 for other bytes, 96 for padding.
_CODE = np.full(256, 95, np.uint8)
_CODE[32:127] = np.arange(95)
_PAD, _N_CODES = 96, 97
_STRIP = 1 << 15


def _base(data: np.ndarray, offsets: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """Per row: (start, kind, end) of the base rules in code points of the row."""
    n = len(offsets) - 1
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
    points = np.concatenate([[0], np.cumsum(tk.code_points(data))])

    def add(kind: int, start: np.ndarray, end: np.ndarray) -> None:
        row = np.searchsorted(offsets, start, "right") - 1
        for r, a, b in zip(row.tolist(), (points[start] - points[offsets[row]]).tolist(), (points[end] - points[offsets[row]]).tolist(), strict=True):
            out[r].append((a, kind, b))

    start, end = tk.runs(_HEX[data], offsets)
    long = end - start >= HEX_MIN
    add(2, start[long], end[long])
    start, end = tk.runs(_UPPER[data], offsets)
    long = end - start >= ACCESS_MIN
    firsts, ends = [], []
    for a, b in zip(start[long].tolist(), end[long].tolist(), strict=True):
        # The leftmost AKIA of the run takes the rest of it.
        k = data[a:b].tobytes().find(b"AKIA")
        if k >= 0 and b - a - k >= ACCESS_MIN:
            firsts.append(a + k), ends.append(b)
    add(1, np.array(firsts, np.int64), np.array(ends, np.int64))
    whole = data.tobytes()
    low = whole.lower()
    if any(k in low for k in KEYWORDS):
        for r in range(n):
            i, j = int(offsets[r]), int(offsets[r + 1])
            if any(low.find(k, i, j) >= 0 for k in KEYWORDS):
                out[r] += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(whole[i:j].decode()) if m.end(2) - m.start(2) >= ASSIGN_MIN]
    return [sorted(x) for x in out]


def _loose(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans of long runs of key characters with a letter or a digit."""
    start, end = tk.runs(_KEY[data], offsets)
    long = end - start >= CANDIDATE
    start, end = start[long], end[long]
    solid = np.concatenate([[0], np.cumsum(_SOLID[data])])
    some = solid[end] > solid[start]
    return start[some], end[some]


def candidates(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, list[tuple[int, int, int]], list[tuple[int, int, tuple[bytes, int, int]]]]]:
    """Per row: its base spans, and its candidates as (start, end, (excerpt, place in it, size in bytes)), base ones first."""
    base = _base(data, offsets)
    start, end = _loose(data, offsets)
    row = np.searchsorted(offsets, start, "right") - 1
    cut = np.searchsorted(row, np.arange(len(base) + 1))
    for r, spans in enumerate(base):
        if not spans and cut[r] == cut[r + 1]:
            yield r, spans, []
            continue
        lo, hi = int(offsets[r]), int(offsets[r + 1])
        text = data[lo:hi]
        begin = np.flatnonzero(tk.code_points(text))
        begin = np.r_[begin, len(text)]
        places = [(int(begin[a]), int(begin[b]), a, b) for a, _, b in spans]
        a, b = start[cut[r] : cut[r + 1]] - lo, end[cut[r] : cut[r + 1]] - lo
        if places:
            # A run meets a base match if, of the matches that begin before its end, the farthest end lies past its start.
            x = np.array(sorted(p[:2] for p in places))
            reach = np.r_[-1, np.maximum.accumulate(x[:, 1])]
            free = reach[np.searchsorted(x[:, 0], b)] <= a
            a, b = a[free], b[free]
        places += zip(a.tolist(), b.tolist(), np.searchsorted(begin, a).tolist(), np.searchsorted(begin, b).tolist(), strict=True)
        yield r, spans, [(a, b, (text[max(0, i - CONTEXT) : j + CONTEXT].tobytes(), min(i, CONTEXT), j - i)) for i, j, a, b in places]


def _sigmoid(u: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(u, -50, 50)))


@dataclass
class Network:
    filters: np.ndarray  # WIDTH x _N_CODES x FILTERS: embedding and filter in one table
    bias: np.ndarray
    out: np.ndarray  # 2 * FILTERS + 1
    scale: tuple[float, float] = (1.0, 0.0)
    threshold: float = 0.5

    def pooled(self, examples: list[tuple[bytes, int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """Maxima over candidate and surroundings (rows x 2 FILTERS), and the WIDTH codes they come from."""
        top, codes = np.zeros((len(examples), 2 * FILTERS)), np.zeros((len(examples), 2 * FILTERS, WIDTH), np.uint8)
        order = sorted(range(len(examples)), key=lambda i: len(examples[i][0]))
        i = 0
        while i < len(order):
            # As many as fit _STRIP characters; a longer one goes alone, strip by strip.
            j = i + 1
            while j < len(order) and (j + 1 - i) * len(examples[order[j]][0]) <= _STRIP:
                j += 1
            own = order[i:j]
            code, inside = encode([examples[k] for k in own])
            best, at = np.full((len(own), 2 * FILTERS), -1.0), np.zeros((len(own), 2 * FILTERS), np.int64)
            for lo in range(0, inside.shape[1], _STRIP):
                within = inside[:, lo : lo + _STRIP]
                n = within.shape[1]
                h = self.bias + sum(self.filters[k][code[:, lo + k : lo + k + n]] for k in range(WIDTH))
                np.maximum(h, 0, out=h)
                real = code[:, lo + WIDTH // 2 : lo + WIDTH // 2 + n] != _PAD
                found = []
                for mask in (within, real & ~within):
                    g = np.where(mask[:, :, None], h, -1.0)
                    where = g.argmax(1)
                    found.append((np.take_along_axis(g, where[:, None], 1)[:, 0], where + lo))
                most, where = (np.concatenate(x, 1) for x in zip(*found, strict=True))
                at = np.where(most > best, where, at)
                best = np.maximum(most, best)
            top[own] = np.maximum(best, 0)
            codes[own] = code[np.arange(len(own))[:, None, None], at[:, :, None] + np.arange(WIDTH)]
            i = j
        return top, codes

    def outputs(self, top: np.ndarray) -> np.ndarray:
        # Row by row: a matrix product may round a row differently in another batch.
        return (top * self.out[:-1]).sum(1) + self.out[-1]

    def logits(self, examples: list[tuple[bytes, int, int]]) -> np.ndarray:
        return self.outputs(self.pooled(examples)[0])

    def weights(self) -> list[np.ndarray]:
        return [self.filters, self.bias, self.out]

    def probability(self, examples: list[tuple[bytes, int, int]]) -> np.ndarray:
        return self.calibrated(self.logits(examples))

    def calibrated(self, z: np.ndarray) -> np.ndarray:
        a, b = self.scale
        return _sigmoid(a * z + b)


def encode(examples: list[tuple[bytes, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, inside) of (excerpt, place, size of the candidate in bytes)."""
    length = max(len(x[0]) for x in examples)
    half = WIDTH // 2
    code = np.full((len(examples), length + 2 * half), _PAD, np.uint8)
    inside = np.zeros((len(examples), length), bool)
    for r, (excerpt, place, size) in enumerate(examples):
        code[r, half : half + len(excerpt)] = _CODE[np.frombuffer(excerpt, np.uint8)]
        inside[r, place : place + size] = True
    return code, inside


def generated(n: int = 300) -> list[tuple[bytes, int, int, int]]:
    """Fixed labelled findings: (excerpt, place, size, label)."""
    rng = np.random.Generator(np.random.PCG64(SEED))
    pick = lambda letters, k: "".join(rng.choice(list(letters), k))
    word = lambda: pick(string.ascii_lowercase, int(rng.integers(3, 10)))
    base64 = string.ascii_letters + string.digits + "+/"
    out = []
    for i in range(n):
        secret = [
            lambda: pick("0123456789abcdef", int(rng.integers(32, 64))),
            lambda: "AKIA" + pick(string.ascii_uppercase + string.digits, 16),
            lambda: pick(base64, int(rng.integers(20, 60))) + "=" * int(rng.integers(0, 3)),
            lambda: pick(string.ascii_letters + string.digits, int(rng.integers(20, 45))),
        ][i % 4]()
        plain = [
            lambda: f"{word()}{rng.integers(0, 99)}.{word()}.com",
            lambda: f"{word()}/{word()}-{rng.integers(1, 99)}/{word()}.html",
            lambda: f"{rng.integers(1990, 2030)}-{rng.integers(1, 12):02d}-{rng.integers(1, 28):02d}T{rng.integers(0, 23):02d}",
            lambda: f"{word()}_{word()}_{word()}_{rng.integers(0, 20)}",
            lambda: f"{word()}-{rng.integers(0, 9)}.{rng.integers(0, 99)}.{rng.integers(0, 9)}-{word()}",
            lambda: word() + word() + word() + word(),
            lambda: "".join(word().capitalize() for _ in range(4)),
            lambda: "-".join(word() for _ in range(4)),
            lambda: pick(string.digits, int(rng.integers(16, 24))),
            lambda: (word() + word() + word() + word()).upper(),
        ][i % 10]()
        for text, label in ((secret, 1), (plain, 0)):
            before = (" ".join(word() for _ in range(4)) + " ")[-CONTEXT:]
            after = (" " + " ".join(word() for _ in range(4)))[:CONTEXT]
            out.append(((before + text + after).encode(), len(before), len(text), label))
    return out


def started() -> Network:
    rng = np.random.Generator(np.random.PCG64(SEED + 1))
    net = Network(rng.normal(0, 0.15, (WIDTH, _N_CODES, FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.1, 2 * FILTERS + 1))
    net.filters[:, _PAD] = 0
    return net


def descend(start: Network, examples: list[tuple[bytes, int, int, int]], *seed: int) -> Network:
    """One pass of minibatch Adam on logistic loss, classes weighed alike."""
    rng = np.random.Generator(np.random.PCG64([SEED + 2, *seed]))
    net = Network(*(w.copy() for w in start.weights()))
    weights = net.weights()
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    y_all = np.array([x[3] for x in examples], float)
    balance = np.where(y_all > 0, 0.5 / max(y_all.mean(), 1e-6), 0.5 / max(1 - y_all.mean(), 1e-6))
    order = rng.permutation(len(examples))
    for step, i in enumerate(range(0, len(order), 64), 1):
        some = order[i : i + 64]
        x, codes = net.pooled([examples[k][:3] for k in some])
        d = (_sigmoid(net.outputs(x)) - y_all[some]) * balance[some] / len(some)
        grads = [np.zeros_like(net.filters), np.zeros_like(net.bias), np.append(x.T @ d, d.sum()) + 1e-4 * net.out]
        g = d[:, None] * net.out[:-1] * (x > 0)
        grads[1] += g.sum(0).reshape(2, FILTERS).sum(0)
        rows, place = np.nonzero(g)
        for k in range(WIDTH):
            np.add.at(grads[0][k], (codes[rows, place, k], place % FILTERS), g[rows, place])
        grads[0][:, _PAD] = 0
        for w, g, m, v in zip(weights, grads, first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def _platt_terms(z: np.ndarray, target: float, scale: float, shift: float) -> np.ndarray:
    """Sums over one class, in units of 2**-20: rows, loss, its gradient by scale and shift, and its curvature."""
    u = np.clip(scale * z + shift, -50, 50)
    p = _sigmoid(u)
    s = p * (1 - p)
    terms = np.stack([np.ones(len(z)), np.logaddexp(0, u) - target * u, (p - target) * z, p - target, s * z * z, s * z, s])
    return np.rint(terms * 2**20).astype(np.int64).sum(1)


def platt(sums) -> tuple[float, float]:
    """Logistic regression of the label on the output, both classes weighed alike, by damped Newton steps.

    ``sums(targets, scale, shift)``: ``_platt_terms`` of none and of secret.
    """
    sizes = [int(x[0]) >> 20 for x in sums((0.0, 1.0), 1.0, 0.0)]
    targets = (1 / (sizes[0] + 2), (sizes[1] + 1) / (sizes[1] + 2))

    def mean(scale, shift):
        x = sum(np.asarray(t[1:], float) / t[0] for t in sums(targets, scale, shift) if t[0])
        return x[0], x[1:3], np.array([[x[3], x[4]], [x[4], x[5]]])

    at, damping = np.array([1.0, 0.0]), 1e-3
    loss, gradient, curvature = mean(*at)
    for _ in range(20):
        step = np.linalg.solve(curvature + damping * np.diag(np.diag(curvature) + 1e-9), gradient)
        if np.abs(step).max() < 1e-4:
            break
        new = mean(*(at - step))
        if new[0] <= loss:
            at, (loss, gradient, curvature), damping = at - step, new, damping / 10
        else:
            damping *= 10
    return float(max(at[0], 0.05)), float(at[1])


def split(examples: list[tuple[bytes, int, int, int]]) -> tuple[list, list]:
    """(trained, held): every fourth example of a class is held."""
    classes = [[x for x in examples if x[3] == label] for label in (0, 1)]
    return [x for c in classes for i, x in enumerate(c) if i % 4 != 3], [x for c in classes for i, x in enumerate(c) if i % 4 == 3]


def train(examples: list[tuple[bytes, int, int, int]]) -> Network:
    """A network of one shard of examples in memory."""
    own, held = split(examples)
    net = started()
    for epoch in range(EPOCHS):
        net = descend(net, own, epoch, 0)
    z = [net.logits([x[:3] for x in held if x[3] == label]) for label in (0, 1)]
    net.scale = platt(lambda targets, *at: [_platt_terms(x, t, *at) for x, t in zip(z, targets, strict=True)])
    net.threshold = float(net.calibrated(np.sort(z[1])[[rank(len(z[1]))]])[0]) if len(z[1]) else 0.5
    return net


def rank(n: int) -> int:
    """Place, from the smallest, of the largest of n outputs that RECALL of them reach."""
    return int((1 - RECALL) * n)


def _findings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, offsets = tk.buffers(b.column(0))
        for _, _, part, at in tk.chunks(data, offsets):
            rows = [(*x, int(k < len(spans))) for _, spans, found in candidates(part, at) for k, (_, _, x) in enumerate(found)]
            if rows:
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int32(), pa.int32(), pa.int32()), strict=True)], names=["excerpt", "place", "size", "label"])


def pack(texts: DataFrame) -> tuple[DataFrame | None, int, int]:
    """(shards, findings, unlabelled ones): all distinct findings, one row a shard: shard int, found array<struct>."""
    found = settle(texts.select("text").mapInArrow(tidied_batches(_findings), "excerpt binary, place int, size int, label int").distinct(), "secret-findings")
    n, n_bytes, n_open = found.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("excerpt")), F.lit(0)), F.count(F.when(F.col("label") == 0, 1))).first()
    if not n:
        return None, 0, 0
    shards = max(-(-n // SHARD), -(-n_bytes // SHARD_BYTES))
    files = max(min(shards, 4 * texts.sparkSession.sparkContext.defaultParallelism), shards // 16)
    key = F.xxhash64("excerpt", "place", "size")
    rows = found.select(F.pmod(key, F.lit(shards)).cast("int").alias("shard"), F.struct("excerpt", "place", "size", "label", (F.pmod(F.xxhash64(key), F.lit(4)) == 0).alias("held")).alias("x"))
    return settle(rows.groupBy("shard").agg(F.array_sort(F.collect_list("x")).alias("found")).repartition(files), "secret-shards"), n, n_open


def _unpacked(b: pa.RecordBatch, keep) -> Iterator[tuple[int, list[tuple[bytes, int, int, int]]]]:
    """Per shard: its findings for which ``keep(label, held)`` holds."""
    for i, shard in enumerate(b.column("shard").to_pylist()):
        fields = [f.to_pylist() for f in b.column("found").slice(i, 1).flatten().flatten()]
        yield shard, [x[:4] for x in zip(*fields, strict=True) if keep(x[3], x[4])]


def _sums(rows: DataFrame, kernel) -> dict[str, np.ndarray]:
    """Exact sums of the whole numbers that ``kernel(batch)`` yields as (key, array)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for k, v in kernel(b):
                sums[k] = sums[k] + v if k in sums else v
        if sums:
            yield pa.RecordBatch.from_pydict({"key": pa.array(list(sums), pa.string()), "blob": pa.array([v.astype("<i8").tobytes() for v in sums.values()], pa.binary())})

    return partition_sums(rows.mapInArrow(tidied_batches(run), "key string, blob binary"), "<i8", fan=4)


def _trained(shards: DataFrame, n: int, least: int) -> Network:
    """EPOCHS passes over the findings with a label of at least ``least``, each averaged over shards by their examples."""
    context = shards.sparkSession.sparkContext
    fixed = split(generated())[0]
    # Weights are summed in units of 2**-bits, which leave room for |w| < 64 and all examples.
    bits = 56 - (n + n * len(fixed)).bit_length()
    net = started()
    for epoch in range(EPOCHS):
        shared = context.broadcast(net)

        def kernel(b, shared=shared, epoch=epoch):
            for shard, own in _unpacked(b, lambda label, held: label >= least and not held):
                own = own + fixed
                w = np.concatenate([x.ravel() for x in descend(shared.value, own, epoch, shard).weights()])
                yield "w", np.rint(np.clip(w, -63, 63) * 2.0**bits).astype(np.int64) * len(own)
                yield "n", np.array([len(own)])

        sums = _sums(shards, kernel)
        shared.destroy()
        parts = np.split(sums["w"] / sums["n"][0] / 2.0**bits, np.cumsum([w.size for w in net.weights()])[:-1])
        net = Network(*(p.reshape(w.shape) for p, w in zip(parts, net.weights(), strict=True)))
    return net


def _held_outputs(shared, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, own in _unpacked(b, lambda label, held: label >= least and held):
                z = shared.value.logits([x[:3] for x in own])
                yield pa.RecordBatch.from_arrays([pa.array([x[3] for x in own], pa.int32()), pa.array(z, pa.float64())], names=["label", "z"])

    return run


def _calibrate(net: Network, shards: DataFrame, least: int) -> None:
    """Scale, shift and threshold from all held findings and the held generated examples."""
    spark = shards.sparkSession
    fixed = split(generated())[1]
    made = [(x[3], float(z)) for x, z in zip(fixed, net.logits([x[:3] for x in fixed]), strict=True)]
    found = settle(shards.mapInArrow(tidied_batches(_held_outputs(spark.sparkContext.broadcast(net), least)), "label int, z double"), "secret-outputs")
    outputs = found.union(spark.createDataFrame(made, "label int, z double"))

    def sums(targets, scale, shift):
        def kernel(b):
            label, z = b.column("label").to_numpy(), b.column("z").to_numpy()
            for k, target in enumerate(targets):
                yield str(k), _platt_terms(z[label == k], target, scale, shift)

        got = _sums(outputs, kernel)
        return [got["0"], got["1"]]

    net.scale = platt(sums)
    own = sorted(z for label, z in made if label)
    least_z = own[rank(len(own))]
    secrets = found.filter("label = 1").select("z")
    n = secrets.count()
    if n:
        least_z = min(least_z, _smallest(secrets, rank(n)))
    net.threshold = float(net.calibrated(np.array([least_z]))[0])


def _smallest(rows: DataFrame, k: int, few: int = 1 << 14) -> float:
    """The value of ``z`` with exactly k values before it in order: counts by equal-width cells, narrowed until ``few`` are left."""
    lo, hi, n = rows.agg(F.min("z"), F.max("z"), F.count("z")).first()
    while n > few and lo < hi:
        width = (hi - lo) / 1024
        cell = F.least(F.floor((F.col("z") - lo) / width), F.lit(1023))
        cells = sorted(tuple(r) for r in rows.groupBy(cell.alias("c")).agg(F.count("*"), F.min("z"), F.max("z")).collect())
        for _, n, lo, hi in cells:
            if k < n:
                break
            k -= n
        rows = rows.filter((F.col("z") >= lo) & (F.col("z") <= hi))
    return lo if lo == hi else sorted(r["z"] for r in rows.collect())[k]


def _without_likely(shared):
    """Shards without the unlabelled findings that look like secrets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for b in batches:
            for i in range(b.num_rows):
                found = b.column("found").slice(i, 1).flatten()
                excerpt, place, size, label, _ = (f.to_pylist() for f in found.flatten())
                keep = np.array(label) == 1
                keep[~keep] = net.probability([x[:3] for x in zip(excerpt, place, size, label, strict=True) if not x[3]]) < 0.5
                found = found.filter(pa.array(keep))
                yield pa.RecordBatch.from_arrays([b.column("shard").slice(i, 1), pa.ListArray.from_arrays(pa.array([0, len(found)], pa.int32()), found)], names=["shard", "found"])

    return run


def learn(texts: DataFrame) -> Network:
    """The network from all findings of ``texts``."""
    shards, n, n_open = pack(texts)
    if shards is None:
        return train(generated())
    net = _trained(shards, n, 1)
    _calibrate(net, shards, 1)
    if n_open:
        shared = texts.sparkSession.sparkContext.broadcast(net)
        shards = settle(shards.mapInArrow(tidied_batches(_without_likely(shared)), shards.schema), "secret-sure")
        net = _trained(shards, n, 0)
        _calibrate(net, shards, 0)
    return net


_OUT = "doc_id long, n_assign long, n_access long, n_hex long, n_model long, base_sha256 string, spans string, best_score double"


def _scan(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for b in batches:
            ids = b.column(0)
            data, offsets = tk.buffers(b.column(1))
            for i, j, part, at in tk.chunks(data, offsets):
                rows, pending = [], []
                for r, spans, found in candidates(part, at):
                    rows.append(list(spans))
                    pending += [(r, k >= len(spans), *x) for k, x in enumerate(found)]
                best: list[float | None] = [None] * (j - i)
                if pending:
                    for p, (r, new, a, z, _) in zip(net.probability([x[4] for x in pending]).tolist(), pending, strict=True):
                        best[r] = max(p, best[r] or 0.0)
                        if new and p >= net.threshold:
                            rows[r].append((a, 3, z))
                write = lambda spans: ",".join(f"{KINDS[k]}:{a}:{z}" for a, k, z in sorted(spans))
                count = [[sum(k == kind for _, k, _ in x) for x in rows] for kind in range(4)]
                base = [hashlib.sha256(write([s for s in x if s[1] < 3]).encode()).hexdigest() for x in rows]
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), *(pa.array(c, pa.int64()) for c in count), pa.array(base, pa.string()), pa.array([write(x) for x in rows], pa.string()), pa.array(best, pa.float64())], names=["doc_id", "n_assign", "n_access", "n_hex", "n_model", "base_sha256", "spans", "best_score"])

    return run


def scan_secrets(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, n_model, base_sha256 of the base spans, spans (all), best_score."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    net = net or learn(texts)
    return texts.mapInArrow(tidied_batches(_scan(docs.sparkSession.sparkContext.broadcast(net))), _OUT)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))
