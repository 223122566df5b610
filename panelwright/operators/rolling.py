"""Windows of a fixed number of rows over a calendar: arithmetic on row numbers, never a range join.

Window w holds the rows [step * w, step * w + width).  ``n`` is the calendar's
number of rows; a calendar shorter than ``width`` has no windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def count_windows(n: int, width: int, step: int) -> int:
    return max(0, (n - width) // step + 1)


def _bounds(at: Column, n: int, width: int, step: int, lag: int = 0) -> tuple[Column, Column]:
    """First and last window that hold both the row and the one ``lag`` after it."""
    lo = F.greatest(F.lit(0), F.floor((at + (lag - width + step)) / F.lit(step)))
    return lo, F.least(F.floor(at / F.lit(step)), F.lit(count_windows(n, width, step) - 1))


def roll(rows: DataFrame, n: int, width: int, step: int, at: str = "r") -> DataFrame:
    """Each row once for every window that holds it, with ``w``."""
    lo, hi = _bounds(F.col(at), n, width, step)
    return rows.withColumn("__lo", lo).withColumn("__hi", hi).filter("__lo <= __hi").withColumn("w", F.explode(F.sequence("__lo", "__hi"))).drop("__lo", "__hi")


def window_table(rolled: DataFrame, at: str = "r", when: str = "d") -> DataFrame:
    """(w, start_row, end_row, start_date, end_date); the end row is exclusive."""
    return rolled.groupBy("w").agg(F.min(at).alias("start_row"), (F.max(at) + 1).alias("end_row"), F.min(when).alias("start_date"), F.max(when).alias("end_date"))


def window_zscore(rolled: DataFrame, key: str = "name", value: str = "v", out: str = "z") -> DataFrame:
    """Z-score of each series in its window (ddof 0, deviation floored at 1e-12)."""
    own = Window.partitionBy("w", key)
    return rolled.withColumn(out, (F.col(value) - F.avg(value).over(own)) / F.greatest(F.stddev_pop(value).over(own), F.lit(1e-12)))


def pair_moments(left: DataFrame, right: DataFrame, n: int, width: int, step: int, lag: int = 0, key: str = "name", at: str = "r", value: str = "v") -> DataFrame:
    """(w, a, b, n, sx, sy, sxx, syy, sxy) over rows r of ``left`` and r + ``lag`` of ``right`` in one window.

    Row pairs are joined once.  Those that lie in the same windows are summed
    before they are repeated for these, so the repeated table has a row per pair
    of series and step, not per row.  Values far from 0 should be centred first.
    """
    a = left.select(F.col(at).alias("r"), F.col(key).alias("a"), F.col(value).cast("double").alias("x"))
    b = right.select((F.col(at) - lag).alias("r"), F.col(key).alias("b"), F.col(value).cast("double").alias("y"))
    lo, hi = _bounds(F.col("r"), n, width, step, lag)
    x, y = F.col("x"), F.col("y")
    sums = {"n": F.count(F.lit(1)), "sx": F.sum(x), "sy": F.sum(y), "sxx": F.sum(x * x), "syy": F.sum(y * y), "sxy": F.sum(x * y)}
    both = a.join(b, "r").filter(x.isNotNull() & y.isNotNull()).withColumn("lo", lo).withColumn("hi", hi).filter("lo <= hi")
    parts = both.groupBy("lo", "hi", "a", "b").agg(*(e.alias(k) for k, e in sums.items()))
    return parts.withColumn("w", F.explode(F.sequence("lo", "hi"))).groupBy("w", "a", "b").agg(*(F.sum(k).alias(k) for k in sums))


def correlation() -> Column:
    """Of ``pair_moments``; null where a series is constant."""
    n, sx, sy = F.col("n"), F.col("sx"), F.col("sy")
    # Rounding may leave a constant series a variance just above or below 0.
    vx, vy = n * F.col("sxx") - sx * sx, n * F.col("syy") - sy * sy
    far = (vx > 1e-12 * n * F.col("sxx")) & (vy > 1e-12 * n * F.col("syy"))
    return F.when(far, (n * F.col("sxy") - sx * sy) / F.sqrt(vx * vy))


def covariance() -> Column:
    """Of ``pair_moments``, ddof 1; null for a single row."""
    return F.try_divide(F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n"), F.col("n") - 1)


def fully_observed(rows: DataFrame, names: DataFrame, n: int, width: int, step: int, key: str = "name", at: str = "r", value: str = "price") -> DataFrame:
    """(w, key, eligible): whether the series has a value in every row of the window."""
    held = roll(rows.filter(F.col(value).isNotNull()).select(at, key).distinct(), n, width, step, at).groupBy("w", key).agg(F.count(F.lit(1)).alias("__n"))
    grid = rows.sparkSession.range(count_windows(n, width, step)).select(F.col("id").alias("w")).crossJoin(names.select(key))
    return grid.join(held, ["w", key], "left").select("w", key, (F.coalesce("__n", F.lit(0)) == width).alias("eligible"))


def trailing(rows: DataFrame, n: int, width: int, step: int, at: str = "r", out: str = "reb") -> DataFrame:
    """Each row once for every rebalance t = step * reb < n whose ``width`` rows before t hold it."""
    r = F.col(at)
    lo, hi = F.floor((r + step) / F.lit(step)), F.least(F.floor((r + width) / F.lit(step)), F.lit((n - 1) // step))
    return rows.withColumn("__lo", lo).withColumn("__hi", hi).filter("__lo <= __hi").withColumn(out, F.explode(F.sequence("__lo", "__hi"))).drop("__lo", "__hi")
