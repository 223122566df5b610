import math

import numpy as np
import pytest

from panelwright.functions import discovery, variants

from test_kernels import chain


def uniform_chain(n, seed):
    x = np.random.default_rng(seed).exponential(size=(n, 3))
    x[:, 1] += 1.2 * x[:, 2]
    x[:, 0] += -0.9 * x[:, 1]
    return x


def test_several_groups_share_a_structure():
    for b in discovery.multi_group_rcd([uniform_chain(300, 1), uniform_chain(400, 2)]):
        assert abs(b[2, 1] - 1.2) < 0.2 and abs(b[1, 0] + 0.9) < 0.2 and b[1, 2] == 0
    rng = np.random.default_rng(7)
    data = []
    for n in (150, 200):
        a = rng.uniform(-2, 2, n)
        data.append(np.column_stack([a, np.tanh(2 * a) + a**2 + 0.3 * rng.uniform(-1, 1, n)]))
    for b in [*discovery.multi_group_resit(data), discovery.multi_group_camuv(data)]:
        assert b[0, 1] == 1 and b[1, 0] == 0


def test_groups_of_variables_come_in_order():
    rng = np.random.default_rng(3)
    x = rng.laplace(size=(3000, 4))
    x[:, [0, 1]] += x[:, [2, 3]] @ np.array([[1.0, 0.5], [-0.7, 0.9]])
    b, order = variants.group_direct_lingam(x, [[0, 1], [2, 3]])
    assert order == [1, 0]
    assert np.abs(b[np.ix_([2, 3], [0, 1])] - np.array([[1.0, 0.5], [-0.7, 0.9]])).max() < 0.1 and not b[:2].any()


def test_moving_averages():
    rng = np.random.default_rng(5)
    b0 = np.array([[0, 0], [0.8, 0]])
    mix = np.linalg.inv(np.eye(2) - b0)
    phi, theta = np.diag([0.5, 0.3]), np.array([[0.4, 0.0], [0.2, 0.3]])
    u = rng.laplace(size=(6000, 2)) @ mix
    x = np.zeros_like(u)
    for t in range(1, len(u)):
        x[t] = x[t - 1] @ phi + u[t] + u[t - 1] @ theta
    assert variants.varma_order(x, 2, 1) == (1, 1)
    bs, omegas, order = variants.varma_lingam(x)
    assert order == [1, 0] and np.abs(bs[0] - b0).max() < 0.06
    assert np.abs(bs[1] - phi @ (np.eye(2) - b0)).max() < 0.08
    assert np.abs(omegas[0] - np.linalg.inv(np.eye(2) - b0) @ theta @ (np.eye(2) - b0)).max() < 0.1


@pytest.mark.parametrize("n", [26, 60, 97])
def test_moving_averages_of_short_and_wide_series(n):
    bs, omegas, order = variants.varma_lingam(np.random.default_rng(0).normal(size=(n, 13)), 2, 1, search=True)
    assert 2 <= len(bs) <= 3 and len(omegas) <= 1 and sorted(order) == list(range(13)) and np.isfinite(bs[0]).all()


def test_missing_values_and_their_causes():
    x = chain(6000)
    rng = np.random.default_rng(8)
    z = (x[:, 2] - x[:, 2].mean()) / x[:, 2].std()
    x[rng.random(len(x)) < 1 / (1 + np.exp(1 - 2 * z)), 1] = np.nan
    b, order, causes = variants.missing_lingam(x)
    assert order == [2, 1, 0] and abs(b[2, 1] - 1.2) < 0.1 and abs(b[1, 0] + 0.9) < 0.1
    assert set(causes) == {1} and 2 in causes[1] and causes[1][2] > 0
    full, same, none = variants.missing_lingam(chain(2000))
    assert none == {} and same == [2, 1, 0] and abs(full[2, 1] - 1.2) < 0.1


def test_mixed_columns():
    rng = np.random.default_rng(2)
    a = rng.laplace(size=4000)
    c = (rng.random(4000) < 1 / (1 + np.exp(-1.5 * a))).astype(float)
    y = 2.0 * c + rng.laplace(size=4000)
    k = rng.poisson(np.exp(0.3 * a)).astype(float)
    b = variants.mixed_lingam(np.column_stack([a, c, y, k]), ["continuous", "binary", "continuous", "count"])
    assert abs(b[0, 1] - 1.5) < 0.2 and abs(b[1, 2] - 2) < 0.2 and abs(b[0, 3] - 0.3) < 0.1 and (b != 0).sum() == 3


def test_factors_behind_indicators():
    rng = np.random.default_rng(6)
    out = []
    for _ in range(2):
        f = rng.laplace(size=(4000, 2))
        f[:, 0] += 1.0 * f[:, 1]
        f /= f.std(0)
        out.append(np.column_stack([f[:, [0]] * [0.9, 0.8, 0.95], f[:, [1]] * [0.9, 0.95, 0.85]]) + 0.2 * rng.normal(size=(4000, 6)))
    clusters = [[0, 1, 2], [3, 4, 5]]
    scores, loadings = variants.factor_scores(out[0], clusters)
    assert loadings.min() > 0.9 and scores.shape == (4000, 2)
    bs, order = variants.latent_lingam(out, clusters)
    assert order == [1, 0] and all(abs(b[1, 0] - math.sqrt(0.5)) < 0.07 and b[0, 1] == 0 for b in bs)


def test_fit_indices_tell_graphs_apart():
    x = chain(3000)
    right = np.array([[0, 0, 0], [-0.9, 0, 0], [0, 1.2, 0]])
    good, bad = variants.fit_indices(x, right), variants.fit_indices(x, np.array([[0, 0, 0], [-0.9, 0, 0], [0, 0, 0]]))
    assert good["dof"] == 1 and good["p"] > 0.001 and good["cfi"] > 0.99 and good["rmsea"] < 0.06
    assert bad["cfi"] < 0.9 and bad["rmsea"] > 0.2 and bad["bic"] > good["bic"]
    # The likelihood by its definition, with the implied covariance matrix.
    b = np.zeros((3, 3))
    b[1, 0], b[2, 1] = discovery.slopes(x[:, [1]], x[:, 0])[0], discovery.slopes(x[:, [2]], x[:, 1])[0]
    e = (x - x.mean(0)) @ (np.eye(3) - b)
    way = np.linalg.inv(np.eye(3) - b)
    implied = way.T @ np.diag(e.var(0)) @ way
    s = np.cov(x.T, bias=True)
    f = np.linalg.slogdet(implied)[1] + np.trace(s @ np.linalg.inv(implied)) - np.linalg.slogdet(s)[1] - 3
    assert good["chi2"] == pytest.approx(3000 * f, abs=1e-6)
    with pytest.raises(ValueError):
        variants.fit_indices(x, np.full((3, 3), np.nan))
