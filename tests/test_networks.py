import itertools

import numpy as np
import pytest

from panelwright.functions import factors
from panelwright.functions.factors import BayesNet, Factor
from panelwright.operators import networks


def diamond():
    rng = np.random.default_rng(0)
    cpd = lambda *shape: rng.dirichlet(np.ones(shape[-1]), size=shape[:-1]) if shape[:-1] else rng.dirichlet(np.ones(shape[-1]))
    states = {"a": [0, 1], "b": [0, 1, 2], "c": ["x", "y"], "d": [False, True], "e": [0, 1]}
    return BayesNet(states, {"a": Factor(("a",), cpd(2)), "b": Factor(("a", "b"), cpd(2, 3)), "c": Factor(("a", "c"), cpd(2, 2)), "d": Factor(("b", "c", "d"), cpd(3, 2, 2)), "e": Factor(("d", "e"), cpd(2, 2))})


def brute(net, name, evidence):
    out = np.zeros(len(net.states[name]))
    order = sorted(net.states)
    for pick in itertools.product(*(range(len(net.states[n])) for n in order)):
        at = dict(zip(order, pick, strict=True))
        if all(net.states[n][at[n]] == v for n, v in evidence.items()):
            out[at[name]] += np.prod([f.table[tuple(at[m] for m in f.names)] for f in net.cpds.values()])
    return out / out.sum()


def test_elimination_equals_enumeration():
    net = diamond()
    for evidence in ({}, {"e": 1}, {"e": 0, "b": 2}, {"c": "x", "d": True}):
        for name in net.states:
            assert np.allclose(factors.marginals(net, evidence)[name], brute(net, name, evidence))


def test_do_leaves_what_is_upstream_alone():
    net = diamond()
    did = factors.intervene(net, "b", {2: 1.0})
    assert np.allclose(factors.marginals(did)["a"], factors.marginals(net)["a"])
    assert not np.allclose(factors.marginals(net, {"b": 2})["a"], factors.marginals(net)["a"])
    with pytest.raises(ValueError):
        factors.intervene(net, "b", {2: 0.5})
    with pytest.raises(ValueError):
        factors.query(net, ["a"], {"b": 7})


def test_fit_predict_and_sample(spark):
    rows = [(i % 2, (i // 2) % 3, (i % 2) * ((i // 2) % 3), None if i == 5 else "k") for i in range(60)]
    df = spark.createDataFrame(rows, "a int, b int, y int, other string")
    net = networks.fit_network(df, [("a", "y"), ("b", "y")])
    assert net.cpds["y"].table[1, 2].tolist() == [0, 0, 1]
    test = spark.createDataFrame([(1, 2, None), (0, None, None), (None, None, None), (9, 9, None)], "a int, b int, y int")
    got = networks.predict(test, net, "y").orderBy("a").collect()
    assert len(got) == 4 and {(r.a, r.b): r.y_prediction for r in got} == {(1, 2): 2, (0, None): 0, (None, None): 0, (9, 9): 0}
    drawn = networks.sample(spark, net, 3000, 1)
    assert drawn.filter("y != a * b").count() == 0
    assert abs(drawn.filter("b = 2").count() / 3000 - 1 / 3) < 0.05
    with pytest.raises(ValueError):
        networks.fit_network(df.select("a", "other"), [("a", "other")])


def test_unseen_parents_are_uniform_and_priors_spread():
    assert factors.normalise(np.array([[0, 0], [3, 1]])).tolist() == [[0.5, 0.5], [0.75, 0.25]]
    assert factors.normalise(np.array([3, 1]), 1).tolist() == [4 / 6, 2 / 6]


def test_em_climbs_and_separates(spark):
    rng = np.random.default_rng(3)
    z = rng.random(4000) < 0.4
    cols = [np.where(z, rng.random(4000) < 0.9, rng.random(4000) < 0.1).astype(int) for _ in range(3)]
    df = spark.createDataFrame([tuple(int(c[i]) for c in cols) for i in range(4000)], "p int, q int, r int")
    net, history = networks.fit_latent(df, [("z", "p"), ("z", "q"), ("z", "r")], "z", 2, prior=0.0)
    assert all(b >= a - 1e-6 for a, b in zip(history, history[1:], strict=False))
    assert abs(sorted(net.cpds["z"].table)[0] - 0.4) < 0.05
    assert np.allclose(sorted(net.cpds["p"].table[:, 1]), [0.1, 0.9], atol=0.06)


def test_supervised_cuts(spark):
    df = spark.createDataFrame([(float(i), "lo" if i < 40 else "hi") for i in range(100)] + [(None, "lo")], "v double, t string")
    for method in ("mdlp", "tree"):
        assert networks.supervised_cuts(df, "v", "t", method) == [39.5]
    assert networks.supervised_cuts(df.filter("v > 1000"), "v", "t") == []
