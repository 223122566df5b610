"""Graphs of windows as edge tables (w, src, dst, weight): thresholds, comparisons, probabilities, effects and paths.

An edge table has one row for each edge with a weight other than 0.  Effects and
depths follow an ``order`` (name, position) in which edges point forward; names
in alphabetical order are the default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["w", "src", "dst"]


def threshold(edges: DataFrame, least: float, strict: bool = False) -> DataFrame:
    size = F.abs("weight")
    return edges.filter(size > least if strict else size >= least)


def density(edges: DataFrame, nodes: int) -> DataFrame:
    """(w, n_edges, density, mean_weight): edges over ordered pairs of different nodes; the mean is of absolute weights."""
    pairs = max(nodes * (nodes - 1), 1)
    return edges.filter("src <> dst").groupBy("w").agg(F.count(F.lit(1)).alias("n_edges"), (F.count(F.lit(1)) / pairs).alias("density"), F.avg(F.abs("weight")).alias("mean_weight"))


def beside_previous(edges: DataFrame, windows: DataFrame) -> DataFrame:
    """(w, src, dst, x, y): weights in a window and in the one before, absent ones 0, for windows that have one before."""
    now = edges.select(*KEY, F.col("weight").alias("x"))
    then = edges.select((F.col("w") + 1).alias("w"), "src", "dst", F.col("weight").alias("y"))
    both = windows.select("w").distinct().join(windows.select((F.col("w") + 1).alias("w")).distinct(), "w")
    return now.join(then, KEY, "full").join(F.broadcast(both), "w").select(*KEY, F.coalesce("x", F.lit(0.0)).alias("x"), F.coalesce("y", F.lit(0.0)).alias("y"))


def frobenius(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("w").agg(F.sqrt(F.sum((F.col("x") - F.col("y")) ** 2)).alias("dist"))


def edge_jaccard(pairs: DataFrame) -> DataFrame:
    """(w, jaccard) of the edge sets; a pair without any edge has no row (its Jaccard is 1)."""
    both = F.sum(F.when((F.col("x") != 0) & (F.col("y") != 0), 1).otherwise(0))
    return pairs.filter("x <> 0 or y <> 0").groupBy("w").agg((both / F.count(F.lit(1))).alias("jaccard"))


def compare(first: DataFrame, second: DataFrame) -> DataFrame:
    """(w, frobenius, jaccard, sign_agreement, weight_corr) of two graphs on the edges that either has; null where not defined."""
    pairs = first.select(*KEY, F.col("weight").alias("x")).join(second.select(*KEY, F.col("weight").alias("y")), KEY, "full").na.fill(0.0, ["x", "y"])
    x, y = F.col("x"), F.col("y")
    common = F.sum(F.when((x != 0) & (y != 0), 1).otherwise(0))
    agree = F.sum(F.when((x != 0) & (y != 0) & (F.signum(x) == F.signum(y)), 1).otherwise(0))
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return pairs.groupBy("w").agg(F.sqrt(F.sum((x - y) ** 2)).alias("frobenius"), (common / F.count(F.lit(1))).alias("jaccard"), F.try_divide(agree, common).alias("sign_agreement"), F.when(spread > 1e-15, F.try_divide(F.covar_pop(x, y), spread)).alias("weight_corr"))


def flags(values: DataFrame, sigmas: float = 1.5, value: str = "dist") -> DataFrame:
    """``values`` with ``flagged``: above the mean plus so many deviations (ddof 0) of all rows, strictly."""
    edge = values.agg((F.avg(value) + sigmas * F.stddev_pop(value)).alias("__edge"))
    return values.crossJoin(F.broadcast(edge)).withColumn("flagged", F.col(value) > F.col("__edge")).drop("__edge")


def sector_flow(edges: DataFrame, sectors: DataFrame) -> DataFrame:
    """(w, sector_from, sector_to, flow): absolute weights over the number of ordered pairs of different names."""
    a, b = (sectors.select(F.col("name").alias(n), F.col("sector").alias(s)) for n, s in (("src", "sector_from"), ("dst", "sector_to")))
    pairs = a.crossJoin(b).filter("src <> dst").groupBy("sector_from", "sector_to").agg(F.count(F.lit(1)).alias("n"))
    found = edges.join(F.broadcast(a), "src").join(F.broadcast(b), "dst").filter("src <> dst").groupBy("w", "sector_from", "sector_to").agg(F.sum(F.abs("weight")).alias("flow"))
    return found.join(F.broadcast(pairs), ["sector_from", "sector_to"]).select("w", "sector_from", "sector_to", (F.col("flow") / F.col("n")).alias("flow"))


def kendall(ranks: DataFrame) -> DataFrame:
    """(w, tau) of each window's ranks (w, name, k) with those of the window before, over pairs of names that both have."""
    then = ranks.select((F.col("w") + 1).alias("w"), "name", F.col("k").alias("j"))
    both = ranks.join(then, ["w", "name"])
    a, b = (both.select("w", *(F.col(c).alias(c + s) for c in ("name", "k", "j"))) for s in ("1", "2"))
    sign = F.signum((F.col("k1") - F.col("k2")) * (F.col("j1") - F.col("j2")))
    return a.join(b, "w").filter("name1 < name2").groupBy("w").agg(F.avg(sign).alias("tau"))


def edge_probability(effects: DataFrame, replicates: int, least: float = 0.0) -> DataFrame:
    """(src, dst, prob): the share of the replicates ``w`` in which |weight| > ``least``."""
    return threshold(effects, least, True).groupBy("src", "dst").agg((F.count_distinct("w") / replicates).alias("prob"))


def effect_summary(effects: DataFrame, replicates: int, least: float = 0.01) -> DataFrame:
    """(src, dst, prob, median): the share of replicates with |effect| > ``least``, and the median of those that are not 0."""
    strong = F.sum(F.when(F.abs("effect") > least, 1).otherwise(0))
    return effects.groupBy("src", "dst").agg((strong / replicates).alias("prob"), F.percentile(F.when(F.col("effect") != 0, F.col("effect")), F.lit(0.5)).alias("median"))


def direction_counts(edges: DataFrame, least: int = 1, limit: int | None = None) -> DataFrame:
    """(src, dst, sgn, n) with at least ``least`` occurrences, the ``limit`` most frequent."""
    found = edges.groupBy("src", "dst", F.signum("weight").cast("int").alias("sgn")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    return found if limit is None else found.orderBy(F.desc("n"), "src", "dst", "sgn").limit(limit)


def dag_counts(edges: DataFrame) -> DataFrame:
    """(pattern, n): windows by their set of edges."""
    return edges.groupBy("w").agg(F.concat_ws(",", F.array_sort(F.collect_list(F.concat("src", F.lit(">"), "dst")))).alias("pattern")).groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))


def common_edges(edges: DataFrame, least: int) -> DataFrame:
    """(src, dst, sgn) of edges in at least ``least`` windows, always with one sign."""
    sign = F.signum("weight").cast("int")
    return edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"), F.min(sign).alias("sgn"), F.max(sign).alias("other")).filter((F.col("n") >= least) & (F.col("sgn") == F.col("other"))).select("src", "dst", "sgn")


def common_probability(edges: DataFrame, groups: DataFrame, how: str = "across") -> DataFrame:
    """(src, dst, prob) of an edge in every result ``g`` of ``groups`` (w, g).

    ``across``: the product of its probabilities in the results; ``per``: the
    share of replicates (windows at one place of each result, ``i``) in which all
    results have it.  An edge that a result never has gets 0.
    """
    total = groups.select("g").distinct().count()
    if how == "across":
        size = groups.groupBy("g").agg(F.count_distinct("w").alias("n"))
        p = edges.join(F.broadcast(groups), "w").groupBy("g", "src", "dst").agg(F.count_distinct("w").alias("k")).join(F.broadcast(size), "g")
        return p.groupBy("src", "dst").agg(F.when(F.count(F.lit(1)) < total, 0.0).otherwise(F.exp(F.sum(F.ln(F.col("k") / F.col("n"))))).alias("prob"))
    places = groups.groupBy("i").agg(F.count_distinct("g").alias("n")).filter(F.col("n") == total).select("i")
    whole = max(places.count(), 1)
    held = edges.join(F.broadcast(groups.join(places, "i", "left_semi")), "w").groupBy("i", "src", "dst").agg(F.count_distinct("g").alias("k"))
    return held.groupBy("src", "dst").agg((F.sum(F.when(F.col("k") == total, 1).otherwise(0)) / whole).alias("prob"))


def _forward(edges: DataFrame, order: DataFrame | None) -> DataFrame:
    """Edges with the positions ``i`` and ``j`` of their ends; one that points backward is an error of the order."""
    nodes = edges.select(F.col("src").alias("name")).unionByName(edges.select(F.col("dst").alias("name"))).distinct()
    if order is None:
        order = nodes.withColumn("position", (F.row_number().over(Window.orderBy("name")) - 1).cast("int"))
    at = lambda end, out: order.select(F.col("name").alias(end), F.col("position").cast("int").alias(out))
    placed = edges.join(F.broadcast(at("src", "i")), "src").join(F.broadcast(at("dst", "j")), "dst")
    return placed.withColumn("i", F.when(F.col("i") < F.col("j"), F.col("i")).otherwise(F.raise_error(F.lit("an edge points backward in the order"))))


def _per_source(edges: DataFrame, order: DataFrame | None, start: Column, step) -> DataFrame:
    """(w, src, at, out): a fold over a window's edges in topological order, from every source, JVM-side.

    When an edge's turn comes, all that leads to its tail has been added, so one
    pass replaces the enumeration of paths; a group is one window's graph.
    """
    placed = _forward(edges, order)
    graph = placed.groupBy("w").agg(F.array_sort(F.collect_list(F.struct("i", "j", "weight"))).alias("es"), F.array_sort(F.collect_set(F.struct("i", "src"))).alias("sources"), (F.max("j") + 1).alias("d"))
    each = graph.select("w", "es", "d", F.explode("sources").alias("s"))
    state = F.transform(F.sequence(F.lit(0), F.col("d") - 1), lambda k: F.when(k == F.col("s.i"), start).otherwise(F.lit(None)))
    folded = each.withColumn("state", F.aggregate("es", state, step))
    return folded.select("w", F.col("s.src").alias("src"), F.col("s.i").alias("i"), F.posexplode("state").alias("j", "out")).filter("out is not null and j <> i")


def _named(found: DataFrame, edges: DataFrame, order: DataFrame | None) -> DataFrame:
    names = _forward(edges, order).select("dst", "j").distinct()
    return found.join(F.broadcast(names), "j")


def total_effects(edges: DataFrame, order: DataFrame | None = None) -> DataFrame:
    """(w, src, dst, effect, paths): sums of products of weights over all paths, and how many paths there are."""
    one = F.struct(F.lit(1.0).alias("e"), F.lit(1).cast("long").alias("n"))

    def step(state: Column, edge: Column) -> Column:
        tail = F.get(state, edge["i"])
        add = lambda x: F.struct((F.coalesce(x["e"], F.lit(0.0)) + tail["e"] * edge["weight"]).alias("e"), (F.coalesce(x["n"], F.lit(0).cast("long")) + tail["n"]).alias("n"))
        return F.when(tail.isNull(), state).otherwise(F.transform(state, lambda x, k: F.when(k == edge["j"], add(x)).otherwise(x)))

    found = _named(_per_source(edges, order, one, step), edges, order)
    return found.select("w", "src", "dst", F.col("out.e").alias("effect"), F.col("out.n").alias("paths"))


def depths(edges: DataFrame, order: DataFrame | None = None) -> DataFrame:
    """(w, node, depth): edges on the longest way from a node without parents."""

    def step(state: Column, edge: Column) -> Column:
        tail = F.get(state, edge["i"])
        return F.when(tail.isNull(), state).otherwise(F.transform(state, lambda x, k: F.when(k == edge["j"], F.greatest(x, tail + 1)).otherwise(x)))

    ends = roles(edges)
    longest = _named(_per_source(edges, order, F.lit(0), step), edges, order).join(ends.filter("exogenous").select("w", F.col("node").alias("src")), ["w", "src"], "left_semi")
    far = longest.groupBy("w", F.col("dst").alias("node")).agg(F.max("out").alias("depth"))
    return far.unionByName(ends.filter("exogenous").select("w", "node", F.lit(0).alias("depth")))


def roles(edges: DataFrame) -> DataFrame:
    """(w, node, exogenous, sink) of the nodes with an edge."""
    ends = edges.select("w", F.col("src").alias("node"), F.lit(0).alias("p"), F.lit(1).alias("c")).unionByName(edges.select("w", F.col("dst").alias("node"), F.lit(1).alias("p"), F.lit(0).alias("c")))
    return ends.groupBy("w", "node").agg((F.max("p") == 0).alias("exogenous"), (F.max("c") == 0).alias("sink"))


def paths(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """(w, path, effect) of every path from ``src`` to ``dst`` without a repeated node.

    Rounds of joins against the edges, broadcast as one window's graph is small;
    the number of paths is the result's size and may be exponential in the edges.
    """
    from ..sources.store import settle

    edges = settle(edges.select(*KEY, "weight"), "edges")
    step = F.broadcast(edges.withColumnsRenamed({"src": "__at", "dst": "__to", "weight": "__by"}))
    front = edges.filter(F.col("src") == src).select("w", F.array("src", "dst").alias("nodes"), F.col("weight").alias("effect"))
    done = []
    while True:
        front = settle(front, "paths")
        done.append(front.filter(F.element_at("nodes", -1) == dst))
        open_ = front.filter(F.element_at("nodes", -1) != dst)
        if open_.limit(1).count() == 0:
            break
        open_ = open_.withColumn("__at", F.element_at("nodes", -1))
        front = open_.join(step, ["w", "__at"]).filter(~F.array_contains("nodes", F.col("__to"))).select("w", F.concat("nodes", F.array("__to")).alias("nodes"), (F.col("effect") * F.col("__by")).alias("effect"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("w", F.concat_ws(">", "nodes").alias("path"), "effect")


def path_summary(found: DataFrame, replicates: int, least: float = 0.0) -> DataFrame:
    """(path, prob, effect): the share of replicates that have the path, and its median effect."""
    return found.filter(F.abs("effect") > least).groupBy("path").agg((F.count(F.lit(1)) / replicates).alias("prob"), F.percentile("effect", F.lit(0.5)).alias("effect"))


def markov_blanket(edges: DataFrame) -> DataFrame:
    """(w, node, other): parents, children and the children's other parents."""
    up = edges.select("w", F.col("dst").alias("node"), F.col("src").alias("other"))
    down = edges.select("w", F.col("src").alias("node"), F.col("dst").alias("other"))
    a, b = (edges.select("w", "dst", F.col("src").alias(n)) for n in ("node", "other"))
    return up.unionByName(down).unionByName(a.join(b, ["w", "dst"]).filter("node <> other").select("w", "node", "other")).distinct()


def target_subgraph(edges: DataFrame, node: str) -> DataFrame:
    """The edges of the connected part that has ``node``, by rounds of joins: as many as the part is deep."""
    from ..sources.store import settle

    both = settle(edges.select("w", F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(edges.select("w", F.col("dst").alias("a"), F.col("src").alias("b"))).distinct(), "links")
    seen = both.filter(F.col("a") == node).select("w", "a").distinct()
    n = -1
    while True:
        seen = settle(seen, "seen")
        now = seen.count()
        if now == n:
            break
        n = now
        seen = seen.unionByName(both.join(seen, ["w", "a"]).select("w", F.col("b").alias("a"))).distinct()
    return edges.join(seen.withColumnRenamed("a", "src"), ["w", "src"], "left_semi")


def accuracy(found: DataFrame, truth: DataFrame, nodes: int) -> DataFrame:
    """(w, extra, missing, reversed, shd, fdr, tpr, fpr, precision, nnz) of directed edges against those of one true graph (src, dst)."""
    true = truth.select("src", "dst").distinct()
    n_true = max(true.count(), 0)
    e = found.select(*KEY).distinct()
    both = F.lit(True)
    hit = e.join(F.broadcast(true.withColumn("__t", both)), ["src", "dst"], "left").join(F.broadcast(true.select(F.col("src").alias("dst"), F.col("dst").alias("src"), both.alias("__v"))), ["src", "dst"], "left")
    back = e.select("w", F.col("dst").alias("src"), F.col("src").alias("dst"), both.alias("__b"))
    hit = hit.join(back, KEY, "left")
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    t, v = F.col("__t").isNotNull(), F.col("__v").isNotNull()
    got = hit.groupBy("w").agg(F.count(F.lit(1)).alias("nnz"), count(t).alias("tp"), count(~t & v).alias("reversed"), count(~t & ~v).alias("extra"), count(~t & v & F.col("__b").isNull()).alias("turned"))
    pairs = nodes * (nodes - 1) / 2
    missing = F.lit(n_true) - F.col("tp") - F.col("turned")
    shd = F.col("extra") + F.col("reversed") + missing
    fp = F.col("extra") + F.col("reversed")
    return got.select(
        "w", F.col("extra").cast("long").alias("extra"), missing.cast("long").alias("missing"), F.col("reversed").cast("long").alias("reversed"), shd.cast("long").alias("shd"),
        (fp / F.greatest("nnz", F.lit(1))).alias("fdr"), (F.col("tp") / max(n_true, 1)).alias("tpr"), (fp / max(pairs - n_true, 1.0)).alias("fpr"), (F.col("tp") / F.greatest("nnz", F.lit(1))).alias("precision"), F.col("nnz").cast("long").alias("nnz"),
    )


def interventions(effects: DataFrame, moments: DataFrame) -> DataFrame:
    """(w, src, dst, raised, lowered): the mean of dst with src a deviation above and below its mean.

    ``effects``: total effects; ``moments``: w, name, mean, sd.
    """
    s, m = moments.select("w", F.col("name").alias("src"), "sd"), moments.select("w", F.col("name").alias("dst"), "mean")
    shift = F.col("sd") * F.col("effect")
    return effects.join(s, ["w", "src"]).join(m, ["w", "dst"]).select("w", "src", "dst", (F.col("mean") + shift).alias("raised"), (F.col("mean") - shift).alias("lowered"))
