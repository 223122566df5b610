"""Metrics as aggregates, weights, backtests, attribution and bootstrap over return tables.

Metrics are functions from a column of simple returns to an aggregate column, so
they work in ``groupBy(..).agg(..)`` over any grouping; a caller's own statistic
is any such function.  Null returns are passed over.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from .selection import scrambled

Statistic = Callable[[Column], Column]
INF = float("inf")


def sharpe(g: Column, periods: int = 252) -> Column:
    """0 for no returns and for a deviation (ddof 0) under 1e-12."""
    sd = F.stddev_pop(g)
    return F.when((F.count(g) == 0) | (sd < 1e-12), 0.0).otherwise(F.sqrt(F.lit(float(periods))) * F.avg(g) / F.greatest(sd, F.lit(1e-12)))


def _loss(g: Column) -> Column:
    return F.sqrt(F.avg(F.when(g < 0, g * g)))


def sortino(g: Column, periods: int = 252) -> Column:
    """Over the root mean square of the negative returns; without any, +inf (no returns: 0)."""
    loss = F.coalesce(_loss(g), F.lit(0.0))
    return F.when(F.count(g) == 0, 0.0).when(loss < 1e-12, INF).otherwise(F.sqrt(F.lit(float(periods))) * F.avg(g) / F.greatest(loss, F.lit(1e-12)))


def growth(g: Column, periods: int = 252) -> Column:
    """Compound growth a year; 0 for no returns, -1 after a total loss."""
    whole = F.sum(F.when(g > -1, F.log1p(g)))
    return F.when(F.count(g) == 0, 0.0).when(F.min(g) <= -1, -1.0).otherwise(F.exp(whole * periods / F.greatest(F.count(g), F.lit(1))) - 1)


def volatility(g: Column, periods: int = 252) -> Column:
    return F.coalesce(F.stddev_pop(g), F.lit(0.0)) * F.sqrt(F.lit(float(periods)))


def downside(g: Column, periods: int = 252) -> Column:
    return F.coalesce(_loss(g), F.lit(0.0)) * F.sqrt(F.lit(float(periods)))


def certainty_equivalent(g: Column, gamma: float, periods: int = 252) -> Column:
    return periods * (F.avg(g) - 0.5 * gamma * F.var_pop(g))


def herfindahl(w: Column) -> Column:
    return F.sum(F.coalesce(w, F.lit(0.0)) ** 2)


def effective_number(w: Column) -> Column:
    """1 / HHI; +inf where HHI is under 1e-12."""
    h = herfindahl(w)
    return F.when(h < 1e-12, INF).otherwise(1 / F.greatest(h, F.lit(1e-12)))


def wealth(returns: DataFrame, when: str = "d", g: str = "g", by: list[str] | None = None) -> DataFrame:
    """``returns`` with ``nav``, ``peak`` and ``fall`` = nav / peak - 1; the first peak is the first nav."""
    order = Window.partitionBy(*(by or [])).orderBy(when)
    nav = F.when(F.min(g).over(order) <= -1, 0.0).otherwise(F.exp(F.sum(F.log1p(F.greatest(F.col(g), F.lit(-1 + 1e-15)))).over(order)))
    peaked = returns.withColumn("nav", nav).withColumn("peak", F.max("nav").over(order))
    return peaked.withColumn("fall", F.when(F.col("peak") > 0, F.col("nav") / F.greatest(F.col("peak"), F.lit(1e-300)) - 1).otherwise(0.0))


def calmar(growth_rate: Column, fall: Column) -> Column:
    """Growth over the deepest fall; +inf without a fall."""
    return F.when(F.abs(fall) < 1e-12, INF).otherwise(growth_rate / F.greatest(F.abs(fall), F.lit(1e-12)))


def longest_underwater(wealthy: DataFrame, when: str = "d", by: list[str] | None = None) -> DataFrame:
    """(by, longest): rows in the longest run below the peak; 0 without one."""
    by = by or []
    under = F.when(F.col("nav") < F.col("peak") - 1e-12, 1).otherwise(0)
    placed = wealthy.withColumn("__u", under)
    run = F.row_number().over(Window.partitionBy(*by).orderBy(when)) - F.row_number().over(Window.partitionBy(*by, "__u").orderBy(when))
    runs = placed.withColumn("__run", run).groupBy(*by, "__run", "__u").agg(F.sum("__u").alias("__n"))
    return runs.groupBy(*by).agg(F.max("__n").cast("long").alias("longest")) if by else runs.agg(F.coalesce(F.max("__n"), F.lit(0)).cast("long").alias("longest"))


def turnover(weights: DataFrame, when: str = "r", name: str = "name", w: str = "w") -> DataFrame:
    """(when, turnover): half the absolute change against the rebalance before, over the union of names; the first is against cash."""
    dates = weights.select(when).distinct()
    dates = dates.withColumn("__k", F.row_number().over(Window.orderBy(when)))
    own = weights.join(dates, when).select("__k", name, F.coalesce(F.col(w), F.lit(0.0)).alias("__w"))
    before = own.select((F.col("__k") + 1).alias("__k"), name, F.col("__w").alias("__b"))
    moved = own.join(before, ["__k", name], "full").groupBy("__k").agg((0.5 * F.sum(F.abs(F.coalesce("__w", F.lit(0.0)) - F.coalesce("__b", F.lit(0.0))))).alias("turnover"))
    return dates.join(moved, "__k").select(when, "turnover")


def holding(returns: DataFrame, rebalances: DataFrame, step: int, at: str = "r") -> DataFrame:
    """Rows of ``returns`` with ``reb``, the rebalance row whose holding period (t, t + step] has them.

    ``rebalances`` has the rows t, at least ``step`` apart, in column ``at``; the
    as-of is a union and a window, so no range join.
    """
    asked = returns.select("*", F.lit(0).alias("__src"))
    marks = rebalances.select(F.col(at), F.lit(1).alias("__src")).distinct()
    both = asked.unionByName(marks, allowMissingColumns=True)
    last = F.last(F.when(F.col("__src") == 1, F.col(at)), True).over(Window.orderBy(at, "__src").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("reb", last).filter((F.col("__src") == 0) & (F.col(at) <= F.col("reb") + step)).drop("__src")


def backtest(weights: DataFrame, returns: DataFrame, step: int, bps: float = 0.0, periods: int = 252, on_complete: Callable[[Row], None] | None = None) -> tuple[DataFrame, DataFrame]:
    """Daily (r, reb, gross, net), and per rebalance (reb, days, gross, net, turnover, reward).

    ``weights``: r, name, w at each rebalance; ``returns``: r, name, v (simple; a
    missing one counts as 0).  Weights stand for the rows (r, r + step], which may
    not overlap; the turnover's cost falls on the first of them.  The reward is
    the Sharpe ratio over that of equal weights on the same names.  ``on_complete``
    gets each rebalance's row, in order.
    """
    rebalances = weights.select("r").distinct()
    apart = rebalances.agg((F.count(F.lit(1)) < 2).alias("one")).first()["one"] or rebalances.withColumn("g", F.col("r") - F.lag("r").over(Window.orderBy("r"))).agg(F.min("g").alias("g")).first()["g"] >= step
    if not apart:
        raise ValueError("holding periods overlap: rebalances must lie at least `step` rows apart")
    calendar = holding(returns.select("r").distinct(), rebalances, step)
    names = weights.select(F.col("r").alias("reb"), "name", F.coalesce("w", F.lit(0.0)).alias("w"))
    grid = calendar.join(names, "reb").join(returns, ["r", "name"], "left").withColumn("v", F.coalesce("v", F.lit(0.0)))
    costs = turnover(weights).withColumnRenamed("r", "reb")
    daily = grid.groupBy("reb", "r").agg(F.sum(F.col("w") * F.col("v")).alias("gross"), F.avg("v").alias("equal")).join(F.broadcast(costs), "reb")
    first = F.row_number().over(Window.partitionBy("reb").orderBy("r")) == 1
    daily = daily.withColumn("net", F.col("gross") - F.when(first, F.col("turnover") * bps / 1e4).otherwise(0.0))
    whole = lambda c: F.exp(F.sum(F.log1p(c))) - 1
    held = daily.groupBy("reb").agg(F.count(F.lit(1)).alias("days"), whole(F.col("gross")).alias("gross"), whole(F.col("net")).alias("net"), F.first("turnover").alias("turnover"), (sharpe(F.col("net"), periods) - sharpe(F.col("equal"), periods)).alias("reward"))
    if on_complete is not None:
        for row in held.orderBy("reb").toLocalIterator():
            on_complete(row)
    return daily.select("r", "reb", "gross", "net"), held


def weights_by(trailing: DataFrame, strategy: Callable[[int, list[str], np.ndarray], np.ndarray], reb: str = "reb", at: str = "r", step: int = 1) -> DataFrame:
    """(r, name, w) of ``strategy(t, names, matrix)`` at each rebalance; the matrix has the trailing rows that all names share.

    A group is one rebalance's window.  Rows whose series repeats in a row are averaged.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot_table(index=at, columns="name", values="v").sort_index().dropna()
        t = int(pdf[reb].iloc[0]) * step
        if not len(wide):
            return pd.DataFrame(columns=["r", "name", "w"])
        return pd.DataFrame({"r": t, "name": list(wide.columns), "w": np.asarray(strategy(t, list(wide.columns), wide.to_numpy()), float)})

    return trailing.select(reb, at, "name", "v").groupBy(reb).applyInPandas(run, "r long, name string, w double")


def performance(returns: DataFrame, weights: DataFrame | None = None, when: str = "d", g: str = "g", periods: int = 252) -> DataFrame:
    """One row: sharpe, sortino, cagr, vol, downside, cer_1, cer_3, cer_5, mdd, calmar, underwater and, with weights, turnover a year, hhi, effective_n, max_weight (means)."""
    x = F.col(g)
    rich = wealth(returns, when, g)
    stats = rich.agg(
        F.count(x).alias("n"), sharpe(x, periods).alias("sharpe"), sortino(x, periods).alias("sortino"), growth(x, periods).alias("cagr"), volatility(x, periods).alias("vol"), downside(x, periods).alias("downside"),
        *(certainty_equivalent(x, k, periods).alias(f"cer_{k}") for k in (1, 3, 5)), F.min("fall").alias("mdd"),
    )
    stats = stats.withColumn("calmar", calmar(F.col("cagr"), F.col("mdd"))).crossJoin(longest_underwater(rich, when).withColumnRenamed("longest", "underwater"))
    if weights is None:
        return stats
    each = weights.groupBy("r").agg(herfindahl(F.col("w")).alias("h"), effective_number(F.col("w")).alias("e"), F.max(F.coalesce("w", F.lit(0.0))).alias("m"))
    shape = each.agg(F.avg("h").alias("hhi"), F.avg("e").alias("effective_n"), F.avg("m").alias("max_weight"))
    moved = turnover(weights).agg(F.avg("turnover").alias("mean"), F.count(F.lit(1)).alias("times"))
    return stats.crossJoin(shape).crossJoin(moved).withColumn("turnover", F.col("mean") * F.col("times") * periods / F.greatest("n", F.lit(1))).drop("mean", "times")


def by_regime(returns: DataFrame, masks: DataFrame, summary: dict[str, Statistic], when: str = "d", g: str = "g") -> DataFrame:
    """(regime, n, ...): the summary in each regime of ``masks`` (when, regime) and over ``all`` rows."""
    rows = returns.select(F.lit("all").alias("regime"), F.col(g).alias("g")).unionByName(returns.join(masks, when).select("regime", F.col(g).alias("g")))
    return rows.groupBy("regime").agg(F.count(F.lit(1)).alias("n"), *(f(F.col("g")).alias(k) for k, f in summary.items()))


def quantile_masks(series: DataFrame, low: float = 0.2, high: float = 0.8, when: str = "d", value: str = "v") -> DataFrame:
    """(when, regime): rows at or below the low quantile of the full sample, and at or above the high one."""
    edges = series.agg(F.percentile(value, F.lit(low)).alias("__lo"), F.percentile(value, F.lit(high)).alias("__hi"))
    rows = series.crossJoin(F.broadcast(edges))
    return rows.filter(F.col(value) <= F.col("__lo")).select(when, F.lit("low").alias("regime")).unionByName(rows.filter(F.col(value) >= F.col("__hi")).select(when, F.lit("high").alias("regime")))


def _uniform(b: Column, k: Column, salt: int) -> Column:
    """A number in (0, 1), the same wherever it runs."""
    return (scrambled(b.cast("long") * 1_103_515_245 + k.cast("long") * 12_345 + salt) + 0.5) / 2_147_483_647.0


def resampled(series: DataFrame, columns: list[str], replicates: int, block: float, when: str = "d", seed: int = 7) -> DataFrame:
    """(b, pos, columns): stationary-bootstrap replicates of the series, all columns drawn together.

    Blocks start anywhere with equal chance, have 1 + Geometric(1 / block) rows
    and wrap at the end.  A replicate needs at most half as many blocks as rows.
    The series is one per portfolio: its rows, not the data's, set the size.
    """
    rows = series.filter(" and ".join(f"`{c}` is not null" for c in columns)).select(*columns, (F.row_number().over(Window.orderBy(when)) - 1).alias("r"))
    n = F.broadcast(rows.agg(F.count(F.lit(1)).alias("n")).filter("n > 0"))
    spark = series.sparkSession
    blocks = spark.range(1, replicates + 1).select(F.col("id").alias("b")).crossJoin(n).withColumn("k", F.explode(F.expr("sequence(0, n div 2)")))
    start = F.floor(_uniform(F.col("b"), F.col("k"), seed) * F.col("n"))
    length = 1 + F.greatest(F.lit(1), F.ceil(F.ln(_uniform(F.col("b"), F.col("k"), seed + 7919)) / float(np.log1p(-1 / max(block, 1 + 1e-9)))))
    order = Window.partitionBy("b").orderBy("k")
    blocks = blocks.withColumn("start", start).withColumn("size", F.least(length, F.col("n"))).withColumn("at", F.sum("size").over(order) - F.col("size")).filter("at < n")
    drawn = blocks.withColumn("i", F.explode(F.expr("sequence(0L, least(size, n - at) - 1)"))).select("b", (F.col("at") + F.col("i")).alias("pos"), ((F.col("start") + F.col("i")) % F.col("n")).alias("r"))
    return drawn.join(F.broadcast(rows), "r").drop("r")


def bootstrap_interval(series: DataFrame, statistic: Statistic, replicates: int = 1000, block: float = 20, level: float = 0.95, when: str = "d", g: str = "g", seed: int = 7) -> DataFrame:
    """One row: estimate, lo, hi of a statistic by the stationary bootstrap."""
    each = resampled(series, [g], replicates, block, when, seed).groupBy("b").agg(statistic(F.col(g)).alias("s"))
    tail = (1 - level) / 2
    return series.agg(statistic(F.col(g)).alias("estimate")).crossJoin(each.agg(F.percentile("s", F.lit(tail)).alias("lo"), F.percentile("s", F.lit(1 - tail)).alias("hi")))


def bootstrap_difference(series: DataFrame, first: str, second: str, statistic: Statistic, replicates: int = 1000, block: float = 20, when: str = "d", seed: int = 7) -> DataFrame:
    """One row: estimate, lo, hi and p of statistic(first) - statistic(second), drawn together; p is twice the share beyond 0, 1 at most."""
    gap = lambda rows: rows.agg((statistic(F.col(first)) - statistic(F.col(second))).alias("s"))
    each = resampled(series, [first, second], replicates, block, when, seed).groupBy("b").agg((statistic(F.col(first)) - statistic(F.col(second))).alias("s"))
    low, high = F.avg(F.when(F.col("s") <= 0, 1.0).otherwise(0.0)), F.avg(F.when(F.col("s") >= 0, 1.0).otherwise(0.0))
    stats = each.agg(F.percentile("s", F.lit(0.025)).alias("lo"), F.percentile("s", F.lit(0.975)).alias("hi"), low.alias("__low"), high.alias("__high"))
    both = gap(series.filter(F.col(first).isNotNull() & F.col(second).isNotNull())).withColumnRenamed("s", "estimate").crossJoin(stats)
    return both.withColumn("p", F.least(F.lit(1.0), 2 * F.when(F.col("estimate") >= 0, F.col("__low")).otherwise(F.col("__high")))).drop("__low", "__high")


def credit(weights: DataFrame, sensitivities: DataFrame, rewards: DataFrame) -> DataFrame:
    """(w, name, influence, credit): a driver's share of sum |weight * sensitivity|, times the reward; 0 where all influence is under 1e-12.

    ``weights``: w, asset, weight; ``sensitivities``: w, name, asset, s; ``rewards``: w, reward.
    """
    own = sensitivities.join(weights, ["w", "asset"]).groupBy("w", "name").agg(F.sum(F.abs(F.col("weight") * F.col("s"))).alias("influence"))
    total = F.sum("influence").over(Window.partitionBy("w"))
    share = F.when(total < 1e-12, 0.0).otherwise(F.col("influence") / F.greatest(total, F.lit(1e-12)))
    return own.join(rewards, "w").select("w", "name", "influence", (F.col("reward") * share).alias("credit"))


def carried_utility(credits: DataFrame, windows: DataFrame, gamma: float = 0.3, lag: int = 1) -> DataFrame:
    """(w, name, u) after each window of ``windows`` (w): gamma * credit + (1 - gamma) * the utility ``lag`` windows before, where selected; else the utility is carried.

    ``credits``: w, name, credit of the selected drivers.  ``lag`` 1 is the latest
    utility, 2 the one that a gap of a window lets through.  A driver's windows
    are one array: the calendar, not the data, sets its size.
    """
    grid = windows.select("w").distinct().crossJoin(credits.select("name").distinct()).join(credits.select("w", "name", "credit"), ["w", "name"], "left")
    arrays = grid.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("w", "credit"))).alias("rows"))

    # The state starts with a 0, which is cut off at the end.
    def step(done: Column, x: Column) -> Column:
        prior = F.coalesce(F.get(done, F.size(done) - lag), F.lit(0.0))
        return F.concat(done, F.array(F.when(x["credit"].isNull(), prior).otherwise(gamma * x["credit"] + (1 - gamma) * prior)))

    folded = arrays.withColumn("u", F.aggregate("rows", F.array(F.lit(0.0)), step))
    return folded.select("name", F.explode(F.arrays_zip(F.col("rows.w").alias("w"), F.slice("u", 2, F.size("rows")).alias("u"))).alias("x")).select("x.w", "name", "x.u")


def utility_at(utility: DataFrame, asked: DataFrame, gap_days: int = 21, leaky: bool = False) -> DataFrame:
    """``asked`` (d, name) with ``u``, the last utility whose end date lies ``gap_days`` before d at least (``leaky``: after it at most).

    ``utility``: end_date, name, u; rows that share (end_date, name) must be deduplicated with ``append_utility``.
    """
    from .panels import asof

    return asof(asked, utility, "name", "u", "d", "end_date", gap_days if leaky else -gap_days)


def append_utility(store: DataFrame, rows: DataFrame) -> DataFrame:
    """The long store with new rows; of rows for one (end_date, name) the new one stays."""
    both = store.withColumn("__new", F.lit(0)).unionByName(rows.withColumn("__new", F.lit(1)))
    order = Window.partitionBy("end_date", "name").orderBy(F.desc("__new"), F.desc("u"))
    return both.withColumn("__k", F.row_number().over(order)).filter("__k = 1").drop("__k", "__new")
