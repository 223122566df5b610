import numpy as np
import pandas as pd

from panelwright.operators import closed_loop, discovery

NAMES = ["A0", "A1", "A2", "D0", "D1", "D2"]


def windows(n=10, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(104 + 13 * n, 6)) * 0.01
    x[1:, :3] += 0.8 * x[:-1, [3]]  # D0 drives all assets a row later
    return [(w, x[13 * w : 13 * w + 104]) for w in range(n)]


def fitted(**kw):
    return pd.concat([closed_loop.fit(w, NAMES, x) for w, x in windows(**kw)])


def test_planted_driver_is_held_in_every_variant():
    rows = fitted()
    for variant in ("v0", "v1", "v2"):
        out = closed_loop.fold(variant, rows)
        assert len(out) == 9 and all("D0" in d.split(",") for d in out["drivers"])
        assert np.isfinite(out[["gross", "net", "reward", "turnover"]].to_numpy()).all()
        assert (out["net"] <= out["gross"] + 1e-12).all() and abs(out["turnover"].iloc[0] - 0.5) < 1e-9


def test_the_blend_departs_from_the_graph_after_burn_in():
    """Some drivers score alike by the graph; credits tell them apart, so v2's pool leaves v1's."""
    rng = np.random.default_rng(1)
    drivers, assets = ["D0", "D1", "D2", "D3"], ["A0", "A1"]
    rows = []
    for w in range(30):
        x = rng.normal(size=(60, 6)) * 0.01
        rows.append({"w": w, "drivers": drivers, "assets": assets, "x": x.ravel(), "plain": np.ones(4), "causal": np.array([1.0, 0.999, 0.998, 1e-6]), "s": rng.normal(size=(4, 2)).ravel()})
    rows = pd.DataFrame(rows)
    v1, v2 = (closed_loop.fold(v, rows, held_drivers=1, burn_in=3) for v in ("v1", "v2"))
    assert v1["drivers"][:3].tolist() == v2["drivers"][:3].tolist() and (v1["drivers"] != v2["drivers"]).any()
    assert closed_loop.fold("v2", rows, held_drivers=1, burn_in=99).drop(columns="variant").equals(v1.drop(columns="variant"))


def test_the_future_does_not_reach_a_choice():
    rows = fitted()
    whole, cut = closed_loop.fold("v2", rows), closed_loop.fold("v2", rows[rows["w"] < 8])
    assert whole.head(len(cut)).equals(cut)


def test_without_later_windows_there_is_nothing_to_hold():
    assert len(closed_loop.fold("v1", fitted(n=1))) == 0


def test_largest_subgraph(spark):
    rows = [(0, 0, "a", "b", 1.0), (0, 0, "c", "d", 1.0), (0, 0, "d", "e", 1.0), (1, 0, "p", "q", 1.0), (1, 0, "x", "y", 1.0)]
    out = discovery.largest_subgraphs(spark.createDataFrame(rows, "w long, lag int, src string, dst string, weight double"))
    assert {(r.w, r.src, r.dst) for r in out.collect()} == {(0, "c", "d"), (0, "d", "e"), (1, "p", "q")}


def test_thin_windows_are_left_out():
    assert len(closed_loop.fit(0, NAMES, windows()[0][1][:50])) == 0
    assert len(discovery._sensitivities(0, NAMES, windows()[0][1][:50])) == 0


def test_a_window_needs_two_complete_rows_a_series(spark):
    from panelwright.operators.windows import per_window

    rows = [(w, r, n, float(r)) for w, size in ((0, 3), (1, 4)) for r in range(size) for n in ("A0", "D0")]
    df = spark.createDataFrame(rows, "w long, r long, name string, v double")
    out = per_window(df, lambda w, names, x: pd.DataFrame({"w": [w], "n": [len(x)]}), "w long, n long")
    assert [tuple(r) for r in out.collect()] == [(1, 4)]
