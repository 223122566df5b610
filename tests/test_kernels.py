import numpy as np

from panelwright.functions import kernels as k


def chain(n=1500, seed=0):
    e = np.random.default_rng(seed).uniform(-1, 1, (n, 3))
    x = e.copy()
    x[:, 1] += 1.2 * x[:, 2]
    x[:, 0] += -0.9 * x[:, 1]
    return x


def test_direct_lingam_finds_the_chain():
    b, order = k.direct_lingam(chain())
    assert order == [2, 1, 0]
    assert abs(b[2, 1] - 1.2) < 0.1 and abs(b[1, 0] + 0.9) < 0.1 and abs(b[2, 0]) < 0.1


def test_dynamic_graph_is_acyclic_and_keeps_forbidden_edges_out():
    x = chain()
    z = x - x.mean(0)
    forbidden = np.eye(3, dtype=bool)
    forbidden[2, 1] = True
    w, _, _ = k.dynamic_graph(z.T @ z / len(z), 3, forbidden, threshold=0.05)
    assert k.find_cycle(w != 0) is None and w[2, 1] == 0


def test_break_cycles_drops_the_weakest_edge():
    w = np.array([[0, 1.0, 0], [0, 0, 0.2], [0.9, 0, 0]])
    out = k.break_cycles(w)
    assert out[1, 2] == 0 and out[0, 1] == 1.0 and out[2, 0] == 0.9


def test_weights_are_long_only_and_sum_to_one():
    x = np.random.default_rng(3).normal(size=(300, 6))
    c, r = np.cov(x.T), np.corrcoef(x.T)
    for w in (k.hierarchical_weights(c, np.sqrt(0.5 * (1 - r))), k.simplex_weights(c), k.simplex_weights(k.shrunk_covariance(x), x.mean(0), 2.0)):
        assert abs(w.sum() - 1) < 1e-9 and (w >= -1e-9).all()


def test_expm_of_a_rotation():
    a = np.array([[0, -1.0], [1.0, 0]])
    assert np.allclose(k.expm(a), [[np.cos(1), -np.sin(1)], [np.sin(1), np.cos(1)]])


def test_lasso_path_meets_the_optimality_conditions():
    rng = np.random.default_rng(4)
    for d in (1, 3, 8):
        x = rng.normal(size=(60, d)) @ rng.normal(size=(d, d))
        y = rng.normal(size=60) + x[:, 0]
        g, c = x.T @ x / 60, x.T @ y / 60
        path = k.lasso_path(g, c)
        assert path[-1][0] < 1e-9 and np.allclose(path[-1][1], np.linalg.solve(g, c))
        for lam, b in path:
            slack = c - g @ b
            assert (np.abs(slack) <= lam + 1e-9).all()
            assert np.allclose(slack[b != 0], lam * np.sign(b[b != 0]), atol=1e-9)

