import itertools
import math

import numpy as np
import pytest

from panelwright.functions import dependence as dep
from panelwright.functions import discovery as k
from panelwright.operators import discovery as operators

from test_kernels import chain


@pytest.mark.parametrize("a,x", [(1, 2.0), (2, 3.0), (5, 0.1), (5, 30.0), (40, 20.0), (40, 80.0)])
def test_gamma_tail_is_a_poisson_sum(a, x):
    assert dep.gamma_sf(a, x) == pytest.approx(sum(math.exp(i * math.log(x) - x - math.lgamma(i + 1)) for i in range(a)), rel=1e-9)


def test_chi_square_tail_with_one_degree_is_a_normal_tail():
    for z in (0.1, 0.5, 1.0, 1.96, 4.0):
        assert dep.chi2_sf(z * z, 1) == pytest.approx(2 * dep.normal_sf(z), rel=1e-9)


def test_independence_p_values_are_uniform():
    rng = np.random.default_rng(8)
    ps = [dep.hsic_test(*rng.uniform(size=(2, 100)))[1] for _ in range(200)]
    assert 0.4 < np.mean(ps) < 0.6 and np.mean(np.array(ps) < 0.05) < 0.12


def test_dependence_tests_tell_a_square_from_noise():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(2, 300))
    assert dep.hsic_test(x, y)[1] > 0.01 > dep.hsic_test(x, x * x + 0.1 * y)[1]
    assert dep.f_correlation(x, x * x + 0.1 * y) > dep.f_correlation(x, y)
    assert dep.normality_p(x) > 0.01 > dep.normality_p(rng.exponential(size=300))
    assert dep.correlation_p(x, y) > 0.01 > dep.correlation_p(x, x + y)


def test_assignment_is_the_cheapest():
    rng = np.random.default_rng(1)
    for n in range(1, 7):
        c = rng.random((n, n))
        got = k.assign(c)
        assert sorted(got) == list(range(n))
        assert c[np.arange(n), got].sum() == pytest.approx(min(sum(c[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n))))


def test_ica_and_moment_orders_find_the_chain():
    for b, order in (k.ica_lingam(chain(4000)), k.high_dim_lingam(chain(8000))):
        assert order == [2, 1, 0] and abs(b[2, 1] - 1.2) < 0.1


def test_groups_share_an_order():
    bs, order = k.multi_group_lingam([chain(600, 1), chain(900, 2)])
    assert order == [2, 1, 0] and all(abs(b[1, 0] + 0.9) < 0.15 for b in bs)


def test_longitudinal_effects():
    first = chain(2000, 5)
    second = chain(2000, 6)
    second = second + 0.5 * first
    out = {(t, lag): b for t, lag, b in k.longitudinal_lingam([first, second])}
    assert abs(out[1, 0][2, 1] - 1.2) < 0.15 and abs(out[1, 1][2, 2] - 0.5) < 0.1


def test_sinks_first_and_hidden_cause():
    assert abs(k.bottom_up_parce(chain(400), 0.01)[2, 1] - 1.2) < 0.15
    rng = np.random.default_rng(4)
    h, a, b = rng.exponential(size=(3, 400))
    x = np.column_stack([h + 0.5 * a, h + 0.5 * b])
    assert np.isnan(k.bottom_up_parce(x)[0, 1]) and np.isnan(k.rcd(x)[0, 1])
    assert np.isnan(k.bottom_up_parce(x, by_f_correlation=0.01)[0, 1])


def test_rcd_finds_the_chain():
    x = np.random.default_rng(9).exponential(size=(500, 3))
    x[:, 1] += 1.2 * x[:, 2]
    x[:, 0] += -0.9 * x[:, 1]
    b = k.rcd(x)
    assert abs(b[2, 1] - 1.2) < 0.1 and abs(b[1, 0] + 0.9) < 0.1 and b[1, 2] == 0


def test_nonlinear_parents():
    rng = np.random.default_rng(7)
    a = rng.uniform(-2, 2, 250)
    b = np.tanh(2 * a) + a**2 + 0.3 * rng.uniform(-1, 1, 250)
    for out in (k.resit(np.column_stack([a, b])), k.camuv(np.column_stack([a, b]))):
        assert out[0, 1] == 1 and out[1, 0] == 0


def test_groups_in_order():
    assert k.group_lingam(chain(300)) == [[2], [1], [0]]


def test_effects_sum_over_paths():
    b = np.array([[0, 2.0, 3.0], [0, 0, 5.0], [0, 0, 0]])
    assert k.total_effects(b)[0, 2] == 13
    x = chain(300)
    p = k.error_independence(x, np.array([[0, 0, 0], [-0.9, 0, 0], [0, 1.2, 0]]))
    assert p.min() > 0.001 > k.error_independence(x, np.zeros((3, 3))).min()
    assert k.best_intervention(x, b, 0, 2, x[:, 2].mean() + 13) == pytest.approx(x[:, 0].mean() + 1)


def test_autoregressions():
    rng = np.random.default_rng(2)
    x = np.zeros((900, 2))
    for t in range(2, 900):
        x[t] = 0.6 * x[t - 2] + rng.laplace(size=2)
    assert k.select_lags(x) == 2
    m = k.masked_var(x, np.array([[True, False], [True, True]]))
    assert m[0, 1] == 0
    b0, b1 = k.bootstrap_var_lingam(x, 3)
    assert np.isfinite(b0).all() and np.isfinite(b1).all()


def test_thin_windows_do_not_dilute_bootstrap_probabilities(spark, monkeypatch):
    x = chain(300)
    rows = [(w, r, f"F{c}", float(x[r, c])) for w, n in ((0, 300), (1, 4)) for r in range(n) for c in range(3)]
    monkeypatch.setattr(operators, "panel", lambda *_: spark.createDataFrame(rows, "w long, r long, name string, v double"))
    got = {(r["lag"], r["src"], r["dst"]): r["prob"] for r in operators.bootstrap(spark, "", 3).collect()}
    assert got[0, "F2", "F1"] == 1 and got[0, "F1", "F0"] == 1 and min(lag for lag, *_ in got) == 0
