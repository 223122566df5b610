import numpy as np
import pytest

from panelwright.functions import discretise, generators, neural
from panelwright.functions.kernels import find_cycle


def test_sensitivities_of_a_linear_law():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 2))
    y = np.zeros((600, 2))
    y[1:, 0] = 0.8 * x[:-1, 0]
    y[1:, 1] = -0.5 * x[:-1, 1]
    for depth in (1, 2):
        s = neural.sensitivities(x, y + 0.05 * rng.normal(size=y.shape), depth=depth)
        assert np.allclose(s, [[0.8, 0], [0, -0.5]], atol=0.12)
    with pytest.raises(ValueError):
        neural.sensitivities(x[:40], y[:40])


def test_masked_cells_do_not_teach():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(300, 1)), np.zeros((300, 1))
    y[1:] = x[:-1]
    bad = y.copy()
    mask = rng.random(y.shape) < 0.5
    bad[~mask] = 50
    assert abs(neural.sensitivities(x, bad, mask)[0, 0] - 1) < 0.2


def test_nonlinear_graph_finds_a_square():
    rng = np.random.default_rng(2)
    a = rng.uniform(-2, 2, 600)
    x = np.column_stack([a, np.sin(2 * a) + a + 0.1 * rng.normal(size=600), rng.normal(size=600)])
    (w,) = neural.nonlinear_graph(x)
    assert find_cycle(w != 0) is None and w[0, 1] > 0.5 and not w[2].any() and not w[:, 2].any()


def test_lagged_nonlinear_graph():
    rng = np.random.default_rng(3)
    a = rng.normal(size=600)
    b = np.concatenate([[0], np.tanh(2 * a[:-1])]) + 0.1 * rng.normal(size=600)
    now, before = neural.nonlinear_graph(np.column_stack([a, b]), lags=1)
    assert before[0, 1] > 0.5 and before[1, 0] == 0 and not now.any()


def test_column_types():
    x = generators.sem_data(np.array([[0, 1.0, 1.0], [0, 0, 0], [0, 0, 0]]), 800, ["continuous", "binary", "count"], seed=1)
    (w,) = neural.nonlinear_graph(x, ["continuous", "binary", "count"], forbidden=np.array([[[0, 0, 0], [1, 0, 1], [1, 1, 0]]], bool))
    assert w[0, 1] > 0 and w[0, 2] > 0


def test_generated_graphs_and_data():
    for kind in ("erdos", "scale-free", "full"):
        w = generators.random_dag(8, 3, kind, seed=4)
        assert find_cycle(w != 0) is None and (np.abs(w[w != 0]) >= 0.5).all()
    assert (generators.random_dag(5, 0, "full") != 0).sum() == 10
    w = np.array([[0, 1.5], [0, 0]])
    x = generators.sem_data(w, 5000, family="laplace")
    assert abs(np.polyfit(x[:, 0], x[:, 1], 1)[0] - 1.5) < 0.1
    assert set(generators.sem_data(w, 200, ["continuous", "categorical:3"])[:, 1]) <= {0, 1, 2}
    s = generators.stationary_series(w, [3 * np.eye(2)], 300)
    assert s.shape == (300, 2) and np.abs(s).max() < 1e3
    with pytest.raises(ValueError):
        generators.sem_data(w, 5, ["continuous", "odd"])


def test_supervised_cuts():
    values = np.arange(10.0)
    counts = np.array([[50, 0]] * 4 + [[0, 50]] * 6)
    assert discretise.mdlp(values, counts) == [3.5] == discretise.tree_cuts(values, counts)
    same = np.full((10, 2), 5)
    assert discretise.mdlp(values, same) == [] == discretise.tree_cuts(values, same)
    three = np.array([[30, 0, 0]] * 3 + [[0, 30, 0]] * 3 + [[0, 0, 30]] * 4)
    assert discretise.mdlp(values, three) == [2.5, 5.5] == discretise.tree_cuts(values, three)
    assert discretise.mdlp(values[:1], counts[:1]) == []


def test_column_types_are_checked_and_expanded():
    x = np.array([[0.5, 1, 2, 0], [1.5, 0, 0, 3], [2.5, 1, 1, 1]])
    features, owner, kinds = neural.expand_types(x, ["continuous", "binary", "categorical:3", "count"])
    assert owner.tolist() == [0, 1, 2, 2, 2, 3] and features[:, 2:5].tolist() == [[0, 0, 1], [1, 0, 0], [0, 1, 0]]
    for column, kind in ((0, "binary"), (2, "binary"), (3, "categorical:3"), (3, "ordinal:2"), (0, "count"), (0, "text"), (0, "ordinal"), (1, "binary:2")):
        with pytest.raises(ValueError):
            neural.expand_types(x[:, [column]], [kind])


def test_gradients_of_the_losses():
    rng = np.random.default_rng(0)
    level = rng.integers(0, 3, 40).astype(float)[:, None]
    cuts = neural._cuts(level, 3)

    def ordinal(eta):
        k = level.astype(int)[:, 0]
        return -np.log(neural._sigmoid(cuts[k + 1] - eta[:, 0]) - neural._sigmoid(cuts[k] - eta[:, 0])).mean()

    one_hot = np.eye(3)[level.astype(int)[:, 0]]
    softmax = lambda eta: (np.log(np.exp(eta).sum(1)) - (eta * one_hot).sum(1)).mean()
    for kind, loss, y, eta in (("ordinal:3", ordinal, level, rng.normal(size=(40, 1))), ("categorical:3", softmax, one_hot, rng.normal(size=(40, 3)))):
        got = neural._residual(kind, eta, y)
        for i, j in ((0, 0), (7, eta.shape[1] - 1)):
            step = np.zeros_like(eta)
            step[i, j] = 1e-5
            assert got[i, j] == pytest.approx((loss(eta + step) - loss(eta - step)) / 2e-5, abs=1e-6)


def test_nonlinear_graph_of_levels_and_classes():
    rng = np.random.default_rng(1)
    a = rng.normal(size=600)
    level = np.digitize(1.5 * a + rng.logistic(size=600), [-1, 1]).astype(float)
    kind = np.where(a > 0.5, 2, np.where(a < -0.5, 0, 1)).astype(float)
    m = neural.nonlinear_graph(np.column_stack([a, level, kind, rng.normal(size=600)]), ["continuous", "ordinal:3", "categorical:3", "continuous"], forbidden=np.isin(np.arange(16), [4, 8, 6, 9]).reshape(1, 4, 4))[0]
    assert m.shape == (4, 4) and m[0, 1] > 0 and m[0, 2] > 0 and not m[3].any() and not m[:, 3].any()
