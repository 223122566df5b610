"""Driver selection per window: scores, blends, knees, nulls and false discovery rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rolling import correlation, pair_moments


def correlations(left: DataFrame, right: DataFrame, n: int, width: int, step: int, lags: tuple[int, ...] = (0, 1), least: int = 10, **names: str) -> DataFrame:
    """(w, a, b, lag, rho) of pairs with at least ``least`` common rows."""
    out = None
    for lag in lags:
        part = pair_moments(left, right, n, width, step, lag, **names).filter(F.col("n") >= least).select("w", "a", "b", F.lit(lag).alias("lag"), correlation().alias("rho"))
        out = part if out is None else out.unionByName(part)
    return out


def cumulative_scores(rho: DataFrame) -> DataFrame:
    """(w, name, score): the sum of a driver's absolute correlations over lags and assets."""
    return rho.groupBy("w", F.col("a").alias("name")).agg(F.sum(F.abs("rho")).alias("score"))


def top(scores: DataFrame, k: int, by: list[str] | None = None, score: str = "score", name: str = "name") -> DataFrame:
    """The ``k`` largest scores of each group, with ``k``, their place; ties go to the smaller name."""
    order = Window.partitionBy(*(by or ["w"])).orderBy(F.desc(score), name)
    return scores.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= k)


def stage_a(effects: DataFrame, quantile: float = 0.9) -> DataFrame:
    """(w, src, score): a driver's effects at or above the quantile of all nonzero absolute ones in the window."""
    size = F.abs("weight")
    edge = effects.filter("weight <> 0").groupBy("w").agg((F.percentile(size, F.lit(quantile)) - 1e-9).alias("__thr"))
    return effects.join(F.broadcast(edge), "w").groupBy("w", "src").agg(F.sum(F.when(size >= F.col("__thr"), size).otherwise(0.0)).alias("score"))


def zscore(value: Column, by: list[str]) -> Column:
    """ddof 0; 0 where the deviation is under 1e-12."""
    own = Window.partitionBy(*by)
    sd = F.stddev_pop(value).over(own)
    return F.when(sd < 1e-12, 0.0).otherwise((value - F.avg(value).over(own)) / F.greatest(sd, F.lit(1e-12)))


def blend(scores: DataFrame, utility: DataFrame, alpha: float = 0.7, burn_in: int = 6) -> DataFrame:
    """(w, name, blended): alpha z(score) + (1 - alpha) z(utility), the score's rank alone in the first windows.

    ``scores``: w, name, score; ``utility``: w, name, u; drivers without a
    utility have 0, drivers with score 0 leave the pool.
    """
    both = scores.join(utility, ["w", "name"], "left").withColumn("u", F.coalesce("u", F.lit(0.0)))
    a = F.when(F.col("w") < burn_in, 1.0).otherwise(alpha)
    mixed = both.withColumn("blended", a * zscore(F.col("score"), ["w"]) + (1 - a) * zscore(F.col("u"), ["w"]))
    return mixed.filter("score > 0").select("w", "name", "blended")


def knee(scores: DataFrame, score: str = "score") -> DataFrame:
    """(w, knee): where the falling curve of ranked scores lies farthest from its chord, the first such place."""
    own, order = Window.partitionBy("w"), Window.partitionBy("w").orderBy(F.desc(score), "name")
    s, k, m = F.col(score), F.row_number().over(order), F.count(F.lit(1)).over(own)
    low, high = F.min(s).over(own), F.max(s).over(own)
    gap = F.round(F.abs(F.try_divide(k - 1, m - 1) + F.try_divide(s - low, high - low) - 1) / F.sqrt(F.lit(2.0)), 9)
    placed = scores.select("w", k.alias("k"), gap.alias("gap"))
    return placed.groupBy("w").agg(F.min_by("k", F.struct(-F.col("gap"), F.col("k"))).cast("long").alias("knee"))


def scrambled(x: Column) -> Column:
    """A hash of whole numbers by squaring modulo a prime: exact 64-bit arithmetic, so any engine gives the same."""
    for _ in range(4):
        x = x % 2_147_483_647
        x = (x * x + 12_345) % 2_147_483_647
    return x


def shuffled(rows: DataFrame, replicates: int, by: list[str], at: str = "r", value: str = "v", seed: int = 0) -> DataFrame:
    """Each series' values permuted within its group, once for each ``b`` of 1..replicates.

    The permutation sorts rows by a hash of window, place, replicate and a number
    of the series (``key``, an integer column), the same wherever it runs.
    """
    each = rows.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    h = scrambled((F.col(at) * 7919 + F.col("b") * 104_729 + F.col("key") * 1_299_709 + F.col("w") * 15_485_863 + seed + 1).cast("long"))
    own = Window.partitionBy(*by, "b")
    source = each.select(*by, "b", F.row_number().over(own.orderBy(h, at)).alias("__k"), F.col(value).alias("__v"))
    target = each.withColumn("__k", F.row_number().over(own.orderBy(at))).drop(value)
    return target.join(source, [*by, "b", "__k"]).drop("__k").withColumnRenamed("__v", value)


def null_scores(shuffled_drivers: DataFrame, assets: DataFrame, lags: tuple[int, ...] = (0, 1), least: int = 10) -> DataFrame:
    """(w, name, b, score): cumulative scores of shuffled drivers (w, r, name, b, v) against assets (w, r, name, v)."""
    a = shuffled_drivers.select("w", "r", "name", "b", F.col("v").alias("x")).withColumn("lag", F.explode(F.array(*map(F.lit, lags))))
    y = assets.select("w", F.col("r").alias("s"), F.col("name").alias("asset"), F.col("v").alias("y"))
    both = a.withColumn("s", F.col("r") + F.col("lag")).join(y, ["w", "s"])
    x, y = F.col("x"), F.col("y")
    sums = {"n": F.count(F.lit(1)), "sx": F.sum(x), "sy": F.sum(y), "sxx": F.sum(x * x), "syy": F.sum(y * y), "sxy": F.sum(x * y)}
    rho = both.groupBy("w", "name", "b", "lag", "asset").agg(*(e.alias(k) for k, e in sums.items())).filter(F.col("n") >= least)
    return rho.groupBy("w", "name", "b").agg(F.sum(F.abs(correlation())).alias("score"))


def monte_carlo_p(real: DataFrame, null: DataFrame) -> DataFrame:
    """(w, name, p) = (1 + how many null scores are at least as large) / (1 + replicates)."""
    n = F.count(F.lit(1))
    over = F.sum(F.when(F.round("null_score", 9) >= F.round("score", 9), 1).otherwise(0))
    return real.join(null.withColumnRenamed("score", "null_score"), ["w", "name"]).groupBy("w", "name").agg(((over + 1) / (n + 1)).alias("p"))


def normal_p(real: DataFrame, null: DataFrame) -> DataFrame:
    """(w, name, p): the normal tail of a score in the null's mean and deviation (ddof 1, floored at 1e-12)."""
    stats = null.groupBy("w", "name").agg(F.avg("score").alias("m"), F.greatest(F.stddev_samp("score"), F.lit(1e-12)).alias("s"))
    z = (F.col("score") - F.col("m")) / F.col("s")
    # Abramowitz and Stegun 7.1.26, within 1.5e-7.  Fixed values: its coefficients.
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    tail = 0.5 * F.exp(-x * x) * t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return real.join(stats, ["w", "name"]).select("w", "name", F.when(z >= 0, tail).otherwise(1 - tail).alias("p"))


def step_up(p: DataFrame, alpha: float, by: list[str] | None = None) -> DataFrame:
    """``p`` with ``selected``: Benjamini-Hochberg at level ``alpha`` within each group."""
    by = by or ["w"]
    own, order = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("p", "name")
    placed = p.withColumn("__k", F.row_number().over(order)).withColumn("__m", F.count(F.lit(1)).over(own))
    last = F.max(F.when(F.col("p") <= F.col("__k") * alpha / F.col("__m") + 1e-12, F.col("p"))).over(own)
    return placed.withColumn("selected", F.coalesce(F.col("p") <= last, F.lit(False))).drop("__k", "__m")


def selected_jaccard(chosen: DataFrame) -> DataFrame:
    """(w, jaccard) of each window's names with those of the window before, for windows that have both."""
    sets = chosen.groupBy("w").agg(F.collect_set("name").alias("now"))
    before = sets.select((F.col("w") + 1).alias("w"), F.col("now").alias("then"))
    return sets.join(before, "w").select("w", (F.size(F.array_intersect("now", "then")) / F.size(F.array_union("now", "then"))).alias("jaccard"))
