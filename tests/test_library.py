"""The library's operators on small tables made by hand, with nulls, ties and empty tables."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.operators import graphs, panels, portfolio, rolling, selection

DAY = dt.date(2020, 1, 1)


def day(k):
    return DAY + dt.timedelta(days=k)


def series(spark, values, name="a"):
    return spark.createDataFrame([(day(k), name, v) for k, v in enumerate(values)], "d date, name string, price double")


def test_changes(spark):
    rows = series(spark, [1.0, 2.0, None, 4.0, 0.0, 3.0])
    got = {k: [r["v"] for r in panels.change(rows, k).orderBy("d").collect()] for k in ("log", "simple", "diff", "level")}
    assert got == {"log": [pytest.approx(math.log(2))], "simple": [1.0, -1.0], "diff": [1.0, -4.0, 3.0], "level": [1.0, 2.0, 4.0, 0.0, 3.0]}
    assert panels.change(rows.limit(0)).count() == 0
    with pytest.raises(ValueError):
        panels.change(rows, "other")


def test_asof_with_a_gap_and_ties(spark):
    left = spark.createDataFrame([(day(k), "a") for k in (0, 5, 30)] + [(day(9), "b")], "d date, name string")
    right = spark.createDataFrame([(day(0), "a", 1.0), (day(5), "a", None), (day(9), "a", 2.0)], "m date, name string, u double")
    got = {(r["d"], r["name"]): r["u"] for r in panels.asof(left, right, "name", "u", "d", "m").collect()}
    assert got == {(day(0), "a"): 1.0, (day(5), "a"): 1.0, (day(30), "a"): 2.0, (day(9), "b"): None}
    got = [r["u"] for r in panels.asof(left.filter("name = 'a'"), right, "name", "u", "d", "m", -21).orderBy("d").collect()]
    assert got == [None, None, 2.0]


def test_fill_eligibility_and_coverage(spark):
    rows = series(spark, [1.0, None, None, 2.0])
    assert [r["price"] for r in panels.forward_fill(rows, 1).orderBy("d").collect()] == [1.0, 1.0, None, 2.0]
    assets = rows.unionByName(series(spark, [5.0, 5.0], "b"))
    drivers = series(spark, [1.0, 1.0, 1.0, 1.0], "x").unionByName(series(spark, [1.0, None, 1.0], "y"))
    got = {(r["d"], r["name"]): (r["price"], r["eligible"]) for r in panels.eligibility(assets, drivers).collect()}
    assert got == {(day(0), "a"): (1.0, True), (day(0), "b"): (5.0, True), (day(2), "a"): (0.0, False), (day(2), "b"): (0.0, False)}
    names = spark.createDataFrame([("a",), ("b",)], "name string")
    assert {r["d"]: (r["resolved"], r["short"], r["missing"]) for r in panels.coverage(assets, names).collect()} == {day(0): (2, False, ""), day(1): (1, True, "a"), day(3): (1, True, "b")}
    assert panels.complete_dates(assets, names).select("d").distinct().collect() == [(day(0),)]


def test_names(spark):
    df = spark.createDataFrame([(" brk.b ", "BRK.B [2] x"), (None, "nan"), ("a", None)], "s string, t string")
    assert [r[0] for r in df.select(panels.normal_ticker(F.col("s"))).collect()] == ["BRK-B", None, "A"]
    assert [r[0] for r in df.select(panels.clean_symbol(F.col("t"))).collect()] == ["BRK.B", "", ""]
    one = spark.createDataFrame([(day(0), day(5))], "a date, b date")
    assert one.select(panels.midpoint(F.col("a"), F.col("b"))).first()[0] == day(2)


@pytest.mark.parametrize("n,width,step", [(50, 12, 5), (50, 12, 4), (30, 30, 7), (10, 12, 5), (41, 7, 9)])
def test_pair_moments_are_those_of_each_window(spark, n, width, step):
    x = np.random.default_rng(n + step).normal(size=(n, 2))
    rows = spark.createDataFrame([(r, "ab"[c], float(x[r, c])) for r in range(n) for c in range(2) if (r, c) != (3, 1)], "r long, name string, v double")
    for lag in (0, 1, 3):
        got = {r["w"]: (r["n"], r["rho"], r["cov"]) for r in rolling.pair_moments(rows, rows, n, width, step, lag).filter("a = 'a' and b = 'b'").select("w", "n", rolling.correlation().alias("rho"), rolling.covariance().alias("cov")).collect()}
        assert sorted(got) == list(range(rolling.count_windows(n, width, step)))
        for w, (k, rho, cov) in got.items():
            at = [r for r in range(step * w, step * w + width - lag) if r + lag != 3]
            assert k == len(at)
            assert rho == pytest.approx(np.corrcoef(x[at, 0], x[np.array(at) + lag, 1])[0, 1]) and cov == pytest.approx(np.cov(x[at, 0], x[np.array(at) + lag, 1])[0, 1])
    held = rolling.roll(rows, n, width, step).groupBy("w").agg(F.min("r"), F.max("r"), F.count(F.lit(1))).collect()
    assert all(lo >= step * w and hi < step * w + width and k >= 2 * width - 1 for w, lo, hi, k in held)


def test_constant_series_have_no_correlation(spark):
    rows = spark.createDataFrame([(r, n, v) for r in range(20) for n, v in (("a", 0.1), ("b", float(r)))], "r long, name string, v double")
    assert {r["rho"] for r in rolling.pair_moments(rows, rows, 20, 10, 5).filter("a <> b").select(rolling.correlation().alias("rho")).collect()} == {None}


def metrics(spark, values):
    g = F.col("g")
    rows = spark.createDataFrame([(day(k), v) for k, v in enumerate(values)], "d date, g double")
    return rows, rows.agg(portfolio.sharpe(g), portfolio.sortino(g), portfolio.growth(g), portfolio.volatility(g), portfolio.downside(g)).first()


def test_metrics_at_their_edges(spark):
    assert tuple(metrics(spark, [])[1]) == (0.0, 0.0, 0.0, 0.0, 0.0)
    _, m = metrics(spark, [0.01, 0.02])
    assert m[1] == math.inf and m[0] == pytest.approx(math.sqrt(252) * 3) and m[2] == pytest.approx((1.01 * 1.02) ** 126 - 1)
    assert metrics(spark, [0.01, 0.01])[1][0] == 0.0 and metrics(spark, [0.5, -1.0, 0.5])[1][2] == -1.0
    rows, m = metrics(spark, [-0.1, 0.2, -0.05, None])
    assert m[1] == pytest.approx(math.sqrt(252) * np.mean([-0.1, 0.2, -0.05]) / math.sqrt((0.01 + 0.0025) / 2))
    rich = portfolio.wealth(rows.filter("g is not null"))
    assert rich.agg(F.min("fall")).first()[0] == pytest.approx(-0.05)  # the first peak is the first nav
    one = spark.createDataFrame([(0.5, 0.0, 1e-13), (0.5, None, 0.0)], "a double, b double, c double")
    assert tuple(one.agg(portfolio.effective_number(F.col("a")), portfolio.effective_number(F.col("b")), portfolio.effective_number(F.col("c"))).first()) == (2.0, math.inf, math.inf)
    assert one.select(portfolio.calmar(F.lit(0.1), F.lit(0.0))).first()[0] == math.inf
    assert portfolio.longest_underwater(portfolio.wealth(rows.limit(0))).first()["longest"] == 0


def test_backtest_with_a_strategy_and_a_hook(spark):
    x = np.random.default_rng(2).normal(scale=0.01, size=(40, 3))
    returns = spark.createDataFrame([(r, "abc"[c], float(x[r, c])) for r in range(40) for c in range(3) if (r, c) != (25, 0)], "r long, name string, v double")
    records = []

    def strategy(t, names, matrix):
        assert matrix.shape in ((10, 3), (9, 3)) and names == ["a", "b", "c"]
        w = np.array([0.5, 0.5, 0.0]) if t % 20 else np.array([0.0, 0.0, 1.0])
        return w

    weights = portfolio.weights_by(rolling.trailing(returns.filter("r <> 25 or name = 'z'"), 40, 10, 10), strategy, step=10)
    assert {(r["r"], r["name"]): r["w"] for r in weights.collect()}[10, "a"] == 0.5
    daily, held = portfolio.backtest(weights, returns, 10, 5.0, on_complete=records.append)
    got = {r["r"]: r for r in daily.collect()}
    cash = 0.5
    for t, w in ((10, [0.5, 0.5, 0]), (20, [0, 0, 1])):
        y = x.copy()
        y[25, 0] = 0
        for r in range(t + 1, t + 11):
            assert got[r]["gross"] == pytest.approx(float(np.dot(w, y[r])))
            assert got[r]["net"] == pytest.approx(got[r]["gross"] - (cash * 5e-4 if r == t + 1 else 0))
        cash = 1.0
    assert [r["reb"] for r in records] == sorted(r["reb"] for r in held.collect()) and min(got) == 11
    with pytest.raises(ValueError):
        portfolio.backtest(weights, returns, 11)


def test_bootstrap_blocks_wrap_and_statistics_are_callables(spark):
    rows = spark.createDataFrame([(day(k), float(k), float(2 * k)) for k in range(23)], "d date, g double, h double")
    got = portfolio.resampled(rows, ["g", "h"], 30, 4).orderBy("b", "pos").collect()
    assert len(got) == 30 * 23 and all(r["h"] == 2 * r["g"] for r in got)
    steps = [(y["g"] - x["g"]) % 23 == 1 for x, y in zip(got, got[1:]) if x["b"] == y["b"]]
    assert 0.6 < np.mean(steps) < 0.95
    out = portfolio.bootstrap_interval(rows, F.avg, 200, 3).first()
    assert out["lo"] < out["estimate"] == 11 < out["hi"]
    gap = portfolio.bootstrap_difference(rows, "g", "h", F.avg, 200, 3).first()
    assert gap["estimate"] == -11 and gap["p"] < 0.05 and gap["hi"] < 0
    assert portfolio.resampled(rows.limit(0), ["g"], 5, 4).count() == 0


def test_utility_is_carried_and_gapped(spark):
    credits = spark.createDataFrame([(0, "a", 1.0), (1, "b", 2.0), (3, "a", -1.0)], "w long, name string, credit double")
    windows = spark.range(4).withColumnRenamed("id", "w")
    got = {(r["w"], r["name"]): r["u"] for r in portfolio.carried_utility(credits, windows, 0.5).collect()}
    assert [got[w, "a"] for w in range(4)] == [0.5, 0.5, 0.5, -0.25] and [got[w, "b"] for w in range(4)] == [0.0, 1.0, 1.0, 1.0]
    got = {(r["w"], r["name"]): r["u"] for r in portfolio.carried_utility(credits, windows, 0.5, lag=2).collect()}
    assert [got[w, "a"] for w in range(4)] == [0.5, 0.0, 0.5, -0.5]
    store = spark.createDataFrame([(day(0), "a", 1.0), (day(30), "a", 2.0)], "end_date date, name string, u double")
    more = portfolio.append_utility(store, spark.createDataFrame([(day(30), "a", 3.0)], store.schema))
    asked = spark.createDataFrame([(day(40), "a"), (day(51), "a")], "d date, name string")
    assert [r["u"] for r in portfolio.utility_at(more, asked).orderBy("d").collect()] == [1.0, 3.0]
    assert [r["u"] for r in portfolio.utility_at(more, asked, leaky=True).orderBy("d").collect()] == [3.0, 3.0]


def test_credit_sums_to_the_reward(spark):
    weights = spark.createDataFrame([(0, "x", 0.5), (0, "y", 0.5), (1, "x", 1.0)], "w long, asset string, weight double")
    s = spark.createDataFrame([(0, "a", "x", 1.0), (0, "a", "y", -1.0), (0, "b", "x", 2.0), (1, "a", "x", 0.0)], "w long, name string, asset string, s double")
    rewards = spark.createDataFrame([(0, 3.0), (1, 5.0)], "w long, reward double")
    got = {(r["w"], r["name"]): r["credit"] for r in portfolio.credit(weights, s, rewards).collect()}
    assert got == {(0, "a"): 1.5, (0, "b"): 1.5, (1, "a"): 0.0}


def test_step_up_knee_blend_and_top(spark):
    p = spark.createDataFrame([(0, n, v) for n, v in zip("abcde", (0.01, 0.02, 0.03, 0.2, 0.9))], "w long, name string, p double")
    assert [r["name"] for r in selection.step_up(p, 0.05).filter("selected").orderBy("name").collect()] == ["a", "b", "c"]
    assert selection.step_up(p, 0.001).filter("selected").count() == 0
    s = spark.createDataFrame([(0, n, v) for n, v in zip("abcde", (10.0, 9.0, 1.0, 0.5, 0.0))], "w long, name string, score double")
    assert selection.knee(s).first()["knee"] == 3
    assert [r["name"] for r in selection.top(s.withColumn("score", F.lit(1.0)), 2).orderBy("k").collect()] == ["a", "b"]
    u = spark.createDataFrame([(0, "e", 5.0), (0, "c", 1.0)], "w long, name string, u double")
    alone = selection.blend(s, u, 0.5, burn_in=1)
    assert alone.count() == 4 and alone.orderBy(F.desc("blended")).first()["name"] == "a"


def test_normal_tail(spark):
    real = spark.createDataFrame([(0, "a", 1.96), (0, "b", -1.0)], "w long, name string, score double")
    null = spark.createDataFrame([(0, n, k, v) for n in "ab" for k, v in enumerate((-1.0, 1.0, -1.0, 1.0))], "w long, name string, b long, score double")
    sd = math.sqrt(4 / 3)
    got = {r["name"]: r["p"] for r in selection.normal_p(real, null).collect()}
    assert got["a"] == pytest.approx(0.5 * math.erfc(1.96 / sd / math.sqrt(2)), abs=1e-6) and got["b"] == pytest.approx(0.5 * math.erfc(-1 / sd / math.sqrt(2)), abs=1e-6)


def test_shuffles_are_permutations(spark):
    rows = spark.createDataFrame([(w, r, n, k, float(100 * r + k)) for w in range(2) for r in range(10) for k, n in enumerate("xy")], "w long, r long, name string, key long, v double")
    got = selection.shuffled(rows, 3, ["w", "name"]).groupBy("w", "name", "b").agg(F.sort_array(F.collect_list("v")).alias("v"), F.collect_list(F.struct("r", "v")).alias("x")).collect()
    assert len(got) == 12 and all(r["v"] == [100.0 * i + "xy".index(r["name"]) for i in range(10)] for r in got)
    assert len({tuple(x["v"] for x in sorted(r["x"])) for r in got}) > 9


def test_graph_effects_depths_and_paths(spark):
    rows = [(0, "a", "b", 2.0), (0, "b", "c", 3.0), (0, "a", "c", 1.0), (0, "c", "d", -1.0), (1, "a", "d", 0.5), (0, "x", "y", 1.0)]
    e = spark.createDataFrame(rows, "w long, src string, dst string, weight double")
    got = {(r["w"], r["src"], r["dst"]): (r["effect"], r["paths"]) for r in graphs.total_effects(e).collect()}
    assert got[0, "a", "c"] == (7.0, 2) and got[0, "a", "d"] == (-7.0, 2) and got[1, "a", "d"] == (0.5, 1) and (0, "d", "a") not in got and len(got) == 8
    assert {(r["w"], r["node"]): r["depth"] for r in graphs.depths(e).collect()} == {(0, "a"): 0, (0, "b"): 1, (0, "c"): 2, (0, "d"): 3, (0, "x"): 0, (0, "y"): 1, (1, "a"): 0, (1, "d"): 1}
    assert {(r["w"], r["path"]): r["effect"] for r in graphs.paths(e, "a", "d").collect()} == {(0, "a>b>c>d"): -6.0, (0, "a>c>d"): -1.0, (1, "a>d"): 0.5}
    assert {(r["src"], r["dst"]) for r in graphs.target_subgraph(e, "d").filter("w = 0").collect()} == {("a", "b"), ("b", "c"), ("a", "c"), ("c", "d")}
    with pytest.raises(Exception, match="backward"):
        graphs.total_effects(spark.createDataFrame([(0, "b", "a", 1.0)], e.schema)).collect()
    order = spark.createDataFrame([("a", 1), ("b", 0)], "name string, position int")
    assert graphs.total_effects(spark.createDataFrame([(0, "b", "a", 1.0)], e.schema), order).first()["effect"] == 1.0
    assert graphs.total_effects(e.limit(0)).count() == 0 and graphs.paths(e.limit(0), "a", "d").count() == 0


def test_graph_accuracy_and_probabilities(spark):
    schema = "w long, src string, dst string, weight double"
    found = spark.createDataFrame([(0, "a", "b", 1.0), (0, "c", "b", 1.0), (0, "a", "d", 1.0)], schema)
    truth = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "src string, dst string")
    r = graphs.accuracy(found, truth, 4).first()
    assert (r["extra"], r["missing"], r["reversed"], r["shd"], r["nnz"]) == (1, 1, 1, 3, 3)
    assert (r["fdr"], r["tpr"], r["fpr"]) == (pytest.approx(2 / 3), pytest.approx(1 / 3), pytest.approx(2 / 3))
    e = spark.createDataFrame([(w, "a", "b", 1.0) for w in range(3)] + [(0, "a", "c", 1.0), (1, "a", "c", -1.0)], schema)
    groups = spark.createDataFrame([(w, w % 2, w // 2) for w in range(4)], "w long, g long, i long")
    assert {r["dst"]: r["prob"] for r in graphs.common_probability(e, groups).collect()} == {"b": pytest.approx(0.5), "c": pytest.approx(0.25)}
    assert {r["dst"]: r["prob"] for r in graphs.common_probability(e, groups, "per").collect()} == {"b": 0.5, "c": 0.5}
    assert graphs.common_edges(e, 2).collect() == [("a", "b", 1)]
    assert {r["dst"]: r["prob"] for r in graphs.edge_probability(e, 4).collect()} == {"b": 0.75, "c": 0.5}


def test_comparisons_of_graphs(spark):
    schema = "w long, src string, dst string, weight double"
    windows = spark.range(3).withColumnRenamed("id", "w")
    e = spark.createDataFrame([(0, "a", "b", 1.0), (1, "a", "b", 2.0), (1, "b", "a", 2.0), (2, "b", "a", 2.0)], schema)
    pairs = graphs.beside_previous(e, windows)
    assert {r["w"]: r["dist"] for r in graphs.frobenius(pairs).collect()} == {1: pytest.approx(math.sqrt(5)), 2: 2.0}
    assert {r["w"]: r["jaccard"] for r in graphs.edge_jaccard(pairs).collect()} == {1: 0.5, 2: 0.5}
    ranks = spark.createDataFrame([(0, "a", 1), (0, "b", 2), (0, "c", 3), (1, "a", 3), (1, "b", 2), (1, "c", 1)], "w long, name string, k long")
    assert graphs.kendall(ranks).first()["tau"] == -1.0


def test_bins(spark):
    rows = spark.createDataFrame([(float(k),) for k in range(101)] + [(None,)], "v double")
    assert panels.cuts_by(rows, "v", "uniform", 4) == [25.0, 50.0, 75.0] and panels.cuts_by(rows, "v", "quantile", 2) == [50.0]
    assert panels.cuts_by(rows, "v", "outlier", share=0.1) == [10.0, 90.0] and panels.cuts_by(rows.limit(0), "v", "uniform") == []
    got = {r["b"]: r["count"] for r in rows.groupBy(panels.bin_of(F.col("v"), [25.0, 50.0]).alias("b")).count().collect()}
    assert got == {0: 25, 1: 25, 2: 51, None: 1}
