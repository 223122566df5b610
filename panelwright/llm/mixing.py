"""Mixing sources to target weights with a low-discrepancy schedule.

* Targets: weights share a multiple of all words; a source takes at most
  ``max_epochs`` times its size and the excess is reshared by weight.
* Documents of a source are laid in a seeded pseudo-random order on an axis of
  words, and the axis is cut into blocks of equal numbers of words.
* Slot t of the schedule maps the golden-ratio point frac((t + 1/2) / phi)
  through the cumulative block shares and so picks a source; the slot's rank
  among the source's slots picks the block (rank modulo the number of blocks).
* Slots join blocks, blocks join the documents that overlap them.

Ranks and word offsets are prefix sums in two steps (sums per piece, then
inside pieces of bounded size), so no source's rows meet in one task.  Of the
data only one row per source reaches the driver.

Defined results: a null text has size 0 and is taken 0 times; a null source is
a source of its own, last in order; rows are documents whether or not ids
repeat, and rows equal in everything lie side by side, so their shares differ by
one more or less turn of a block at most; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textkit as tk
from .support import settle, table

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MAX_EPOCHS = 2.0
BLOCK_WORDS = 4096
MIN_BLOCKS = 256
PIECE_ROWS = 4096
PIECE_SLOTS = 65_536
BROADCAST_SOURCES = 100_000
#: 2**64 over the golden ratio, odd: multiples of it modulo 2**64 are the golden-ratio sequence.
GOLDEN = 0x9E3779B97F4A7C15


def _sizes(keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column("text")
            data, offsets = tk.buffers(text)
            columns = {c: b.column(c) for c in keep}
            # The order inside a source: a seeded hash of text and id.
            columns["size"] = pa.array(tk.count_words(data, offsets))
            ids = b.column("doc_id").fill_null(-1).to_numpy(zero_copy_only=False).astype(np.uint64)
            columns["h"] = pa.array(tk.mix(tk.row_hash(data, offsets, salt=4) ^ tk.mix(ids)).view(np.int64))
            yield pa.RecordBatch.from_pydict(columns)

    return run


def water_fill(sizes: list[int], weights: list[float], total: float, cap: float) -> list[float]:
    """Shares of ``total`` by weight, none above ``cap`` times its size; the excess is reshared by weight."""
    target = [0.0] * len(sizes)
    free = set(range(len(sizes)))
    left = total
    while free:
        w = sum(weights[i] for i in sorted(free))
        over = [i for i in sorted(free) if left * weights[i] / w > cap * sizes[i]]
        if not over:
            for i in free:
                target[i] = left * weights[i] / w
            break
        for i in over:
            target[i] = cap * sizes[i]
            free.discard(i)
            left -= target[i]
    return target


def plan_sources(sizes: list[tuple[str | None, int]], weights=WEIGHTS, share=SHARE, max_epochs=MAX_EPOCHS, block_words=BLOCK_WORDS) -> list[dict]:
    """One row per source in code-point order, null last: target, words per block, blocks and slots."""
    order = sorted(sizes, key=lambda x: (x[0] is None, (x[0] or "").encode("utf-8", "surrogatepass")))
    own = [weights[i % len(weights)] for i in range(len(order))]
    targets = water_fill([n for _, n in order], own, share * sum(n for _, n in order), max_epochs)
    rows = []
    for i, ((source, size), target) in enumerate(zip(order, targets, strict=True)):
        words = max(1, min(block_words, size // MIN_BLOCKS))
        blocks = -(-size // words)
        rows.append({"sid": i, "source": source, "source_size": size, "target": target, "words": words, "blocks": blocks, "slots": min(round(target / words), int(max_epochs * blocks)) if size else 0})
    return rows


def _points(edges: list[int], sids: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts, names = np.array(edges, np.uint64), np.array(sids, np.int32)
        for b in batches:
            slot = b.column(0).to_numpy()
            # frac((t + 1/2) / phi) in 64-bit integers, wrapping: exact, so reruns agree.
            point = slot.astype(np.uint64) * np.uint64(GOLDEN) + np.uint64(GOLDEN >> 1)
            which = np.searchsorted(cuts, point, "right")
            yield pa.RecordBatch.from_pydict({"slot": b.column(0), "sid": pa.array(names[np.minimum(which, len(names) - 1)])})

    return run


def schedule(spark: SparkSession, plan: list[dict]) -> DataFrame:
    """(slot, sid, rank, block): every slot of the schedule and its rank among its source's slots.

    The sequence has as many points as slots are wanted.  A source gets more or
    fewer than its number by the sequence's (logarithmic) discrepancy: what is
    over is left out, and what is missing follows at the end, in the order of
    ranks.
    """
    live = [p for p in plan if p["slots"]]
    total = sum(p["slots"] for p in live)
    if not total:
        return spark.createDataFrame([], "slot long, sid int, rank long, block long")
    edges, edge = [], 0
    for p in live:
        edge += p["slots"]
        edges.append(min((edge << 64) // total, (1 << 64) - 1))
    slots = spark.range(total).mapInArrow(_points(edges, [p["sid"] for p in live]), "slot long, sid int").withColumn("piece", F.expr(f"slot div {PIECE_SLOTS}"))
    wanted = _by_source(spark.createDataFrame([(p["sid"], p["slots"], p["blocks"]) for p in live], "sid int, wanted long, blocks long"), len(live))
    sums = slots.groupBy("piece", "sid").agg(F.count(F.lit(1)).alias("n"))
    base = sums.select("piece", "sid", (F.sum("n").over(Window.partitionBy("sid").orderBy("piece")) - F.col("n")).alias("base"))
    ranked = slots.join(base, ["piece", "sid"]).withColumn("rank", F.col("base") + F.row_number().over(Window.partitionBy("piece", "sid").orderBy("slot")) - 1)
    served = ranked.join(wanted, "sid").filter("rank < wanted").select("slot", "sid", "rank", "blocks")
    got = sums.groupBy("sid").agg(F.sum("n").alias("got"))
    short = wanted.join(got, "sid", "left").withColumn("got", F.coalesce("got", F.lit(0))).filter("got < wanted").withColumn("rank", F.explode(F.expr("sequence(got, wanted - 1)")))
    # A few rows for each source.
    late = short.select((F.lit(total - 1) + F.row_number().over(Window.orderBy("rank", "sid"))).alias("slot"), "sid", "rank", "blocks")
    return served.unionByName(late).select("slot", "sid", "rank", (F.col("rank") % F.col("blocks")).alias("block"))


def _by_source(rows: DataFrame, n: int) -> DataFrame:
    """One row per source: broadcast while there are at most BROADCAST_SOURCES."""
    return F.broadcast(rows) if n <= BROADCAST_SOURCES else rows


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, source): doc_id, size, source_size, target, taken."""
    spark = docs.sparkSession
    sized = settle(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("source").cast("string").alias("source")).mapInArrow(_sizes(["doc_id", "source"]), "doc_id long, source string, size long, h long"), "mix-sizes")
    totals = [(r["source"], r["n"], r["rows"]) for r in sized.groupBy("source").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("rows")).collect()]
    plan = plan_sources([(s, n) for s, n, _ in totals], **options)
    if not plan:
        return sized.select("doc_id", "size", F.lit(0).cast("long").alias("source_size"), F.lit(0.0).alias("target"), F.lit(0).cast("long").alias("taken"))
    dim = spark.createDataFrame([(p["sid"], p["source"], p["source_size"], p["target"], p["words"], p["blocks"]) for p in plan], "sid int, source string, source_size long, target double, words long, blocks long")
    pieces = max(1, -(-sum(r for *_, r in totals) // PIECE_ROWS))
    rows = sized.join(_by_source(dim.withColumnRenamed("source", "s"), len(plan)), F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("piece", F.pmod(F.shiftright("h", 20), F.lit(pieces)))
    sums = rows.groupBy("sid", "piece").agg(F.sum("size").alias("n"))
    base = sums.select("sid", "piece", (F.sum("n").over(Window.partitionBy("sid").orderBy("piece")) - F.col("n")).alias("base"))
    inside = Window.partitionBy("sid", "piece").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    laid = rows.join(base, ["sid", "piece"]).withColumn("lo", F.col("base") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    slots = schedule(spark, plan).groupBy("sid", "block").agg(F.count(F.lit(1)).alias("times"))
    # A source of k blocks has each taken floor or ceil of slots / k times; a document sums its overlaps.
    # Where size > 0, (sid, lo) names a row: offsets are strictly increasing there.
    parts = (
        laid.filter("size > 0")
        .withColumn("block", F.explode(F.expr("sequence(lo div words, (lo + size - 1) div words)")))
        .withColumn("overlap", F.least(F.col("lo") + F.col("size"), (F.col("block") + 1) * F.col("words")) - F.greatest("lo", F.col("block") * F.col("words")))
    )
    keys = ["sid", "lo", "doc_id", "size", "source_size", "target"]
    taken = parts.join(slots, ["sid", "block"], "left").groupBy(*keys).agg(F.sum(F.col("overlap") * F.coalesce("times", F.lit(0))).cast("long").alias("taken"))
    columns = ["doc_id", "size", "source_size", "target", "taken"]
    return taken.select(*columns).unionByName(rows.filter("size = 0").withColumn("taken", F.lit(0).cast("long")).select(*columns))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(table(spark, sf_dir, "documents"))
