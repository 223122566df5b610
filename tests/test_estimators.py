import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.functions import estimators as e
from panelwright.functions import kernels as k
from panelwright.operators import discovery, windows
from test_kernels import chain


def test_prior_knowledge_is_kept():
    x = chain(800)
    known = k.prior_knowledge(["a", "b", "c"], no_paths=[("c", "b")])
    assert k.direct_lingam(x, known)[0][2, 1] == 0
    known = k.prior_knowledge(["a", "b", "c"], exogenous=["a"], paths=[("a", "b")], sinks=["c"])
    b, order = k.direct_lingam(x, known)
    assert order[0] == 0 and order.index(0) < order.index(1) and not b[2].any()
    assert k.direct_lingam(x, np.full((3, 3), -1))[1] == k.direct_lingam(x)[1]


def series(n=3000, seed=0):
    rng = np.random.default_rng(seed)
    x = np.zeros((n, 3))
    for t in range(2, n):
        u = rng.laplace(size=3)
        x[t, 0] = 0.6 * x[t - 2, 0] + u[0]
        x[t, 1] = 0.8 * x[t, 0] + 0.4 * x[t - 1, 2] + u[1]
        x[t, 2] = 0.3 * x[t - 1, 2] + u[2]
    return x


def test_var_lingam_searches_lags_and_prunes():
    x = series()
    assert [k.var_order(x, 4, c) for c in ("bic", "hqic")] == [2, 2]
    b0, b1, b2, order = k.var_lingam(x, 4, "bic", prune=True)
    assert b0[0, 1] == pytest.approx(0.8, abs=0.05) and b1[2, 1] == pytest.approx(0.4, abs=0.06) and b2[0, 0] == pytest.approx(0.6, abs=0.05)
    assert order.index(0) < order.index(1) and (np.abs(b0) > 0.1).sum() == 1 and (np.abs(b1) > 0.1).sum() == 2
    block = np.zeros((3, 3), bool)
    block[0, 1] = True
    c0, c1, _ = k.var_lingam(x, 1, known=np.where(block, 0, -1), allowed=~block)
    assert c0[0, 1] == c1[0, 1] == 0


def test_unit_root_tests_have_p_values():
    rng = np.random.default_rng(5)
    level = [k.adf_test(rng.normal(size=200))[1] for _ in range(20)]
    walk = [k.adf_test(np.cumsum(rng.normal(size=200)))[1] for _ in range(200)]
    assert max(level) < 0.01 and 0.01 <= np.mean(np.array(walk) < 0.05) <= 0.12
    assert k.adf_test(np.cumsum(np.cumsum(rng.normal(size=300))))[2] >= 1
    assert 0.5 * 1.9 < k.kpss_test(rng.normal(size=500))[1] * 10 and k.kpss_test(np.cumsum(rng.normal(size=500)))[1] == 0.01
    assert np.isnan(k.adf_test(np.ones(50))[0]) and np.isnan(k.adf_test(rng.normal(size=19))[1]) and np.isnan(k.kpss_test(np.ones(50))[0])


def test_stationary_series_stay(spark):
    rng = np.random.default_rng(1)
    cols = {"flat": rng.normal(size=200), "walk": np.cumsum(rng.normal(size=200)), "one": np.ones(200)}
    df = spark.createDataFrame([(n, r, float(v)) for n, c in cols.items() for r, v in enumerate(c)], "name string, r long, v double")
    assert windows.stationary(df).groupBy("name").count().collect() == [("flat", 200)]


@pytest.mark.parametrize("method", ["single", "average", "complete", "ward"])
def test_linkages_keep_clusters_together(method):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(4, 2)) * 0.1 + c for c in ((0, 0), (5, 0), (0, 9))])
    p = rng.permutation(12)
    d = np.sqrt(((x[p][:, None] - x[p][None]) ** 2).sum(-1))
    order = [int(p[i]) // 4 for i in k.linkage_order(d, method)]
    assert sorted(order) == [0] * 4 + [1] * 4 + [2] * 4 and sum(a != b for a, b in zip(order, order[1:])) == 2
    w = k.hierarchical_weights(np.cov(rng.normal(size=(50, 12)).T), d, method)
    assert w.sum() == pytest.approx(1) and (w > 0).all()


def test_ward_heights_are_those_of_merged_variance():
    """The first merges of Ward's clustering are those that raise the sum of squares least."""
    x = np.array([[0.0], [1.0], [10.0], [11.5], [30.0]])
    d = np.abs(x - x.T)
    assert [set(k.linkage_order(d, "ward")[:1]), len(k.linkage_order(d, "ward"))] == [{4}, 5]


def test_capped_weights_and_matrices():
    rng = np.random.default_rng(3)
    c = np.cov(rng.normal(size=(60, 6)).T * np.arange(1, 7)[:, None])
    w = k.simplex_weights(c, cap=0.3)
    assert w.max() <= 0.3 + 1e-9 and w.sum() == pytest.approx(1) and k.simplex_weights(c).max() > 0.3
    assert np.allclose(k.simplex_weights(c, cap=0.01), 1 / 6)
    m = k.nearest_psd(np.array([[1.0, 2.0], [2.0, 1.0]]))
    assert np.linalg.eigvalsh(m).min() >= -1e-12 and np.allclose(m, 1.5)
    b = np.array([[0, 0.5], [0, 0]])
    assert np.allclose(k.structural_covariance(b, np.eye(2)), [[1, 0.5], [0.5, 1.25]])
    assert np.allclose(k.causal_distance(b), [[0, np.sqrt(0.5)], [np.sqrt(0.5), 0]])
    assert k.effective_dimension(np.outer([1.0, 2, 3], [1.0, 5, 2, 7])) == 1 and k.effective_dimension(np.zeros((3, 4))) == 0
    assert k.threshold_till_acyclic(np.array([[0, 1.0, 0.1], [0.5, 0, 0], [0, 0, 0]])).tolist() == [[0, 1, 0], [0, 0, 0], [0, 0, 0]]


def test_k_is_calibrated():
    rng = np.random.default_rng(4)
    null = rng.normal(size=(100, 35))
    real = np.r_[np.full(5, 9.0), rng.normal(size=30) * 0.1]
    by_knee, by_null, chosen, sweep = k.calibrate_k(real, null)
    assert by_null == 5 and by_knee in (5, 6) and chosen in (5, 6) and chosen in sweep and sweep == sorted(set(sweep))
    assert k.calibrate_k(np.zeros(4), null[:, :4])[2] == 1


def test_graph_estimators():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(600, 4))
    y = 2 * x[:, 0] - x[:, 2] + 0.3 * rng.normal(size=600)
    m = e.GraphRegressor().fit(x, y)
    assert np.allclose(m.coef_, [2, 0, -1, 0], atol=0.06) and np.corrcoef(m.predict(x), y)[0, 1] > 0.97
    c = e.GraphClassifier().fit(x, np.where(y > 0, "up", "down"))
    assert (c.predict(x) == np.where(y > 0, "up", "down")).mean() > 0.93 and np.allclose(c.predict_probability(x).sum(1), 1)
    with pytest.raises(ValueError):
        e.GraphClassifier().fit(x, np.arange(600) % 3)


def test_simulation_follows_the_graph():
    x = chain(2000)
    g = np.array([[0, 0, 0], [1, 0, 0], [0, 1, 0]])
    s = e.GraphSimulator(g).fit(x)
    again = s.simulate(shuffle=False)
    assert np.allclose(again, x)
    new = s.simulate(1)
    assert np.allclose(np.cov(new.T), np.cov(x.T), atol=0.12)
    fixed = s.simulate(1, inputs={2: np.full(2000, 3.0)})
    wanted = s.models[1].predict(np.array([[3.0]]))[0]
    assert wanted > 3 and fixed[:, 1].mean() == pytest.approx(wanted, abs=0.05)


def test_bootstrap_over_imputations_and_tuning():
    x = chain(800, 3)
    holes = x.copy()
    holes[np.random.default_rng(0).random(x.shape) < 0.05] = np.nan
    out = e.bootstrap_with_imputation(holes, 4)
    assert np.mean([b[2, 1] for b in out]) == pytest.approx(1.2, abs=0.15) and len(out) == 4
    best, scores = e.tune(x, [lambda z: np.zeros((3, 3)), lambda z: k.direct_lingam(z)[0], lambda z: np.ones((3, 3)) - np.eye(3)])
    assert best == 1 and scores[0] == 0 < scores[1]


def test_summaries(spark):
    p = spark.createDataFrame([(0, 0.01), (0, 0.2), (0, 0.9), (0, float("nan")), (1, 0.5)], "w long, p double")
    got = {r["w"]: r for r in discovery.dependence_summary(p).collect()}
    assert got[0]["rejection_rate"] == pytest.approx(1 / 3) and got[0]["median_p"] == 0.2 and got[0]["n"] == 3 and got[0]["warn"] and not got[1]["warn"]
    a = spark.createDataFrame([(0, "x", 0.5), (0, "y", 0.5)], "w long, name string, weight double")
    assert tuple(windows.compare_weights(a, a.withColumn("weight", F.when(F.col("name") == "x", 1.0).otherwise(0.0))).first()) == (0, 0.5, 0.5)
