"""Connected components of an edge table by alternating stars, each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .support import settle


#: Rows of a node from which it is a hub, at least; a table has HUBS hubs at most.
HUB_ROWS, HUBS = 1000, 100_000


def _with_least(rows: DataFrame, n: int) -> DataFrame:
    """``rows`` (a, b) with m, the least b of their a; hubs get theirs by broadcast, so no node's rows meet in one task."""
    least = rows.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
    if n <= HUB_ROWS:  # no hub is possible
        return rows.join(least.select("a", "m"), "a")
    least = settle(least, "least")
    bound = max(HUB_ROWS, n // HUBS)
    # Each hub has more than n / HUBS of the n rows.
    hubs = F.broadcast(least.filter(F.col("n") > bound).select("a", "m"))
    rest = least.filter(F.col("n") <= bound).select("a", "m")
    return rows.join(hubs, "a").unionByName(rows.join(hubs.select("a"), "a", "left_anti").join(rest, "a"))


def _large(e: DataFrame, n: int) -> DataFrame:
    both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _with_least(both, 2 * n).withColumn("m", F.least("a", "m")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")


def _small(e: DataFrame, n: int) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
    met = _with_least(down, n)
    hung = met.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.unionByName(met.select("a", F.col("m").alias("b")).distinct())


def _state(e: DataFrame) -> tuple:
    r = e.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return r["n"], r["x"]


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the least node reachable, for every node that has an edge.

    A star is an edge table in which each node points at its component's least
    node; the rounds stop when both steps leave the table as it is.  Their
    number grows as the logarithm of the number of nodes.
    """
    e = settle(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").distinct(), "edges")
    seen = None
    while True:
        e = settle(_large(e, e.count()).distinct(), "large")
        e = settle(_small(e, e.count()).distinct(), "stars")
        now = _state(e)
        if now == seen or now[0] == 0:
            break
        seen = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
