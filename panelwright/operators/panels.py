"""Series in tall form, (key, when, value): changes, fills, as-of joins, eligibility.  Column names are arguments.

Nulls: a null value is a missing observation.  Repeated (key, when) rows are an
error of the caller unless a function says otherwise; empty tables give empty
results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _along(key: str, when: str):
    return Window.partitionBy(key).orderBy(when)


def change(rows: DataFrame, kind: str = "log", key: str = "name", when: str = "d", value: str = "price", out: str = "v", periods: int = 1) -> DataFrame:
    """(key, when, out): ``log``, ``simple`` or ``diff`` against the row ``periods`` before, or the ``level``; rows without one go."""
    x = F.col(value).cast("double")
    before = F.lag(x, periods).over(_along(key, when))
    ratio = F.try_divide(x, before)
    how = {"log": F.when(ratio > 0, F.ln(ratio)), "simple": ratio - 1, "diff": x - before, "level": x}
    if kind not in how:
        raise ValueError(f"kind must be one of {sorted(how)}")
    return rows.select(key, when, how[kind].alias(out)).filter(F.col(out).isNotNull())


def month_end(rows: DataFrame, key: str = "name", when: str = "d", value: str = "price") -> DataFrame:
    """(m, key, value): the last value of each month, ``m`` being its first day; nulls are passed over."""
    return rows.filter(F.col(value).isNotNull()).groupBy(F.trunc(when, "month").alias("m"), key).agg(F.max_by(value, when).alias(value))


def year_over_year(rows: DataFrame, kind: str = "pct", key: str = "name", when: str = "d", value: str = "price", out: str = "yoy", months: int = 12) -> DataFrame:
    """(m, key, out): month-end value against that of the month ``months`` before, as ``pct`` or ``diff``; a missing month gives none."""
    now = month_end(rows, key, when, value)
    then = now.select(F.add_months("m", months).alias("m"), key, F.col(value).alias("__then"))
    x, y = F.col(value), F.col("__then")
    return now.join(then, ["m", key]).select("m", key, (F.try_divide(x, y) - 1 if kind == "pct" else x - y).alias(out))


def spread_and_ratio(rows: DataFrame, first: str, second: str, key: str = "name", when: str = "d", value: str = "price") -> DataFrame:
    """(when, spread, ratio) of two series on the dates that both have."""
    a = rows.filter(F.col(key) == first).select(when, F.col(value).alias("x"))
    b = rows.filter(F.col(key) == second).select(when, F.col(value).alias("y"))
    return a.join(b, when).select(when, (F.col("x") - F.col("y")).alias("spread"), F.try_divide("x", "y").alias("ratio"))


def available(rows: DataFrame, since: str, until: str | None = None, when: str = "d", value: str = "price") -> DataFrame:
    """Values before ``since`` are null; rows after ``until`` go."""
    out = rows.withColumn(value, F.when(F.col(when) >= F.to_date(F.lit(since)), F.col(value)))
    return out if until is None else out.filter(F.col(when) <= F.to_date(F.lit(until)))


def first_source(sources: list[DataFrame], on: list[str]) -> DataFrame:
    """Rows of the first source that has the key, with ``src``, its number."""
    rows = None
    for k, s in enumerate(sources):
        s = s.withColumn("src", F.lit(k))
        rows = s if rows is None else rows.unionByName(s)
    order = Window.partitionBy(*on).orderBy("src")
    return rows.withColumn("__k", F.row_number().over(order)).filter("__k = 1").drop("__k")


def spine(calendar: DataFrame, names: DataFrame, rows: DataFrame, key: str = "name", when: str = "d") -> DataFrame:
    """Every (date, name), with the row's columns or nulls.  ``names`` is a dimension: the product is the panel's size."""
    return calendar.select(when).crossJoin(names.select(key)).join(rows, [when, key], "left")


def forward_fill(rows: DataFrame, limit: int | None = None, key: str = "name", when: str = "d", value: str = "price") -> DataFrame:
    """The last known value, of ``limit`` rows before at most."""
    frame = _along(key, when).rowsBetween(Window.unboundedPreceding if limit is None else -limit, 0)
    return rows.withColumn(value, F.last(value, True).over(frame))


def asof(left: DataFrame, right: DataFrame, on: str, value: str, left_when: str = "d", right_when: str = "d", days: int = 0) -> DataFrame:
    """``left`` with the last non-null ``value`` of ``right`` at or before its date plus ``days`` (negative: a gap).

    A union in date order and one window: no range join, and rows of ``right``
    may repeat a date (any of them may be the last).
    """
    known = right.filter(F.col(value).isNotNull()).select(F.col(on), F.col(right_when).cast("date").alias("__t"), F.lit(0).alias("__src"), F.col(value).alias("__v"))
    asked = left.select("*", F.date_add(F.col(left_when).cast("date"), days).alias("__t"), F.lit(1).alias("__src"))
    both = asked.unionByName(known, allowMissingColumns=True)
    last = F.last("__v", True).over(Window.partitionBy(on).orderBy("__t", "__src").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn(value, last).filter("__src = 1").drop("__t", "__src", "__v")


def complete_dates(rows: DataFrame, names: DataFrame, key: str = "name", when: str = "d", value: str = "price") -> DataFrame:
    """Rows of the dates on which every name has a value."""
    width = names.select(key).distinct().agg(F.count(F.lit(1)).alias("__w"))
    full = rows.filter(F.col(value).isNotNull()).groupBy(when).agg(F.count_distinct(key).alias("__n")).crossJoin(F.broadcast(width)).filter("__n = __w")
    return rows.join(full.select(when), when, "left_semi")


def eligibility(assets: DataFrame, drivers: DataFrame, key: str = "name", when: str = "d", value: str = "price") -> DataFrame:
    """(when, key, value, eligible): on dates that every driver has, each asset, null as 0 and not eligible."""
    kept = complete_dates(drivers, drivers, key, when, value).select(when).distinct()
    grid = spine(kept, assets.select(key).distinct(), assets.select(when, key, value), key, when)
    return grid.select(when, key, F.coalesce(value, F.lit(0.0)).alias(value), F.col(value).isNotNull().alias("eligible"))


def dense_series(rows: DataFrame, calendar: DataFrame, share: float = 0.95, key: str = "name", value: str = "price") -> DataFrame:
    """(key, n) of the series with a value on at least ``share`` of the calendar."""
    total = F.broadcast(calendar.agg(F.count(F.lit(1)).alias("__t")))
    return rows.groupBy(key).agg(F.count(value).alias("n")).crossJoin(total).filter(F.col("n") >= share * F.col("__t")).select(key, "n")


def coverage(rows: DataFrame, names: DataFrame, least: float = 0.95, key: str = "name", when: str = "d", value: str = "price") -> DataFrame:
    """(when, resolved, coverage, short, missing): how many of the names have a value, and the sorted list of those without."""
    wanted = F.broadcast(names.agg(F.array_sort(F.collect_set(key)).alias("__all")))
    found = rows.filter(F.col(value).isNotNull()).groupBy(when).agg(F.collect_set(key).alias("__has")).crossJoin(wanted)
    n = F.size(F.array_intersect("__has", "__all"))
    share = F.try_divide(n, F.size("__all"))
    return found.select(when, n.cast("long").alias("resolved"), share.alias("coverage"), (share < least).alias("short"), F.concat_ws(",", F.array_except("__all", "__has")).alias("missing"))


def standardise(rows: DataFrame, key: str = "name", value: str = "v", out: str = "z") -> DataFrame:
    """Z-score over the whole series (ddof 0); null for a constant one."""
    own = Window.partitionBy(key)
    return rows.withColumn(out, F.try_divide(F.col(value) - F.avg(value).over(own), F.stddev_pop(value).over(own)))


def lagged(rows: DataFrame, lags: list[int], key: str = "name", at: str = "r", value: str = "v") -> DataFrame:
    """(at, key, k, lagged_v): the value ``k`` rows before, tall; rows without one go."""
    order = _along(key, at)
    wide = rows.select(at, key, *(F.lag(value, k).over(order).alias(f"__{k}") for k in lags))
    cells = F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"__{k}").alias("lagged_v")) for k in lags))
    return wide.select(at, key, F.explode(cells).alias("c")).select(at, key, "c.k", "c.lagged_v").filter("lagged_v is not null")


def realisations(rows: DataFrame, calendar: DataFrame, key: str = "name", when: str = "d", at: str = "r") -> DataFrame:
    """(key, first_d, last_d, n): runs of a series without a gap in the calendar; a row number less its rank is constant in one."""
    placed = rows.select(when, key).join(calendar.select(when, at), when)
    run = F.col(at) - F.row_number().over(_along(key, at))
    return placed.withColumn("__g", run).groupBy(key, "__g").agg(F.min(when).alias("first_d"), F.max(when).alias("last_d"), F.count(F.lit(1)).alias("n")).drop("__g")


def chronological_split(rows: DataFrame, share: float = 0.8, key: str = "name", at: str = "r") -> DataFrame:
    """(key, at, train): the first floor(share * n) rows of each series train."""
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    return rows.select(key, at, (F.row_number().over(_along(key, at)) <= F.floor(F.lit(share) * n)).alias("train"))


def every_nth(calendar: DataFrame, step: int, start: int, at: str = "r") -> DataFrame:
    return calendar.filter((F.col(at) >= start) & ((F.col(at) - start) % step == 0))


def overlap(left: DataFrame, right: DataFrame, key: str = "name", when: str = "d", value: str = "v") -> DataFrame:
    """(a, b, common): dates on which both series have a value."""
    a = left.filter(F.col(value).isNotNull()).select(when, F.col(key).alias("a"))
    b = right.filter(F.col(value).isNotNull()).select(when, F.col(key).alias("b"))
    return a.join(b, when).groupBy("a", "b").agg(F.count(F.lit(1)).alias("common"))


def normal_ticker(symbol: Column) -> Column:
    """Trimmed, upper case, ``.`` as ``-``."""
    return F.regexp_replace(F.upper(F.trim(symbol)), r"\.", "-")


def clean_symbol(symbol: Column) -> Column:
    """The first word without a bracketed note; ``nan`` and null are empty."""
    word = F.split_part(F.split_part(F.trim(F.coalesce(symbol, F.lit(""))), F.lit(" "), F.lit(1)), F.lit("["), F.lit(1))
    return F.when(F.lower(word) == "nan", "").otherwise(word)


def midpoint(start: Column, end: Column) -> Column:
    """The date half way, rounded down."""
    return F.date_add(start, F.floor(F.datediff(end, start) / 2).cast("int"))


def bin_of(value: Column, cuts: list[float]) -> Column:
    """How many cuts are at most the value (null: null)."""
    return F.when(value.isNotNull(), sum((F.when(value >= F.lit(c), 1).otherwise(0) for c in cuts), F.lit(0)))


def cuts_by(rows: DataFrame, value: str, method: str, n: int = 4, share: float = 0.05, points: list[float] | None = None) -> list[float]:
    """Inner cut points of a column: ``uniform``, ``quantile`` (n bins), ``outlier`` (share on either side), ``percentiles`` or ``fixed`` (points)."""
    x = F.col(value).cast("double")
    if method == "fixed":
        return sorted(points or [])
    if method == "uniform":
        lo, hi = rows.agg(F.min(x), F.max(x)).first()
        return [] if lo is None else [lo + (hi - lo) * k / n for k in range(1, n)]
    at = {"quantile": [k / n for k in range(1, n)], "outlier": [share, 1 - share], "percentiles": sorted(points or [])}[method]
    got = rows.agg(F.percentile(x, F.array(*map(F.lit, at))).alias("q")).first()["q"] if at else []
    return list(got or [])
