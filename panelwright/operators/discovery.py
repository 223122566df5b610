"""Discovery kernels per rolling window, per replicate and per group, as queries."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import discovery, kernels, neural, variants
from .windows import EDGES, ROWS_PER_SERIES, panel, per_window

#: Replicates of a bootstrap or a permutation null.
REPLICATES = 20


def tall(w: int, names: list[str], *lags: tuple[int, np.ndarray]) -> pd.DataFrame:
    """Nonzero effects as rows; nan (a pair with a hidden cause) stays nan."""
    rows = [(w, lag, names[i], names[j], float(m[i, j])) for lag, m in lags for i, j in zip(*np.nonzero(m), strict=True)]
    return pd.DataFrame(rows, columns=["w", "lag", "src", "dst", "weight"])


def is_asset(names: list[str]) -> np.ndarray:
    return np.array([n.startswith("A") for n in names])


def edges_query(fit):
    """``fit(matrix, names)`` gives effects [lag 0, lag 1, ...] of each window."""

    def kernel(w: int, names: list[str], x: np.ndarray) -> pd.DataFrame:
        return tall(w, names, *enumerate(fit(x, names)))

    return lambda spark, sf_dir: per_window(panel(spark, sf_dir), kernel, EDGES)


def _nonlinear(lags: int):
    def fit(x, names):
        block = np.outer(is_asset(names), ~is_asset(names))
        return neural.nonlinear_graph(x, lags=lags, forbidden=np.stack([block] * (lags + 1)), rounds=6, inner=200)

    return fit


def _masked(x, names):
    allowed = ~np.outer(is_asset(names), ~is_asset(names))
    return [np.zeros(allowed.shape), discovery.masked_var(x, allowed)]


def _drivers_only(fit):
    """Kernels exponential in the variables look at the drivers alone."""

    def run(x, names):
        keep = np.flatnonzero(~is_asset(names))
        out = np.zeros((len(names),) * 2)
        out[np.ix_(keep, keep)] = fit(x[:, keep])
        return [out]

    return run


def _groups_as_edges(x: np.ndarray) -> np.ndarray:
    out = np.zeros((x.shape[1],) * 2)
    groups = discovery.group_lingam(x)
    for k, g in enumerate(groups):
        out[np.ix_(g, [j for later in groups[k + 1 :] for j in later])] = 1
        for i in g:
            out[i, [j for j in g if j != i]] = np.nan
    return out


def _sensitivities(w: int, names: list[str], x: np.ndarray) -> pd.DataFrame:
    """None for a window with too few complete rows."""
    a = is_asset(names)
    if len(x) < neural.MIN_ROWS + 1:
        return pd.DataFrame(columns=["w", "driver", "asset", "s"])
    z = (x - x.mean(0)) / np.maximum(x.std(0), 1e-12)
    s = neural.sensitivities(z[:, ~a], z[:, a])
    d, t = np.array(names)[~a], np.array(names)[a]
    return pd.DataFrame([(w, d[i], t[j], float(s[i, j])) for i in range(len(d)) for j in range(len(t))], columns=["w", "driver", "asset", "s"])


def _order(w: int, names: list[str], x: np.ndarray) -> pd.DataFrame:
    order = kernels.causal_order(x)
    return pd.DataFrame({"w": w, "position": range(len(order)), "name": [names[i] for i in order]})


def _lags(w: int, names: list[str], x: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"w": [w], "lags": [discovery.select_lags(x, 3)]})


def _errors(w: int, names: list[str], x: np.ndarray) -> pd.DataFrame:
    p = discovery.error_independence(x, kernels.direct_lingam(x)[0])
    return pd.DataFrame([(w, names[i], names[j], p[i, j]) for i in range(len(p)) for j in range(i + 1, len(p))], columns=["w", "a", "b", "p"])


def _effects(w: int, names: list[str], x: np.ndarray) -> pd.DataFrame:
    b = kernels.direct_lingam(x)[0]
    target = int(np.flatnonzero(is_asset(names))[0])
    rows = [(w, names[i], names[target], up, down) for i, up, down in discovery.intervention_pairs(x, b, target)]
    return pd.DataFrame(rows, columns=["w", "cause", "target", "raised", "lowered"])


def _split_error(w: int, names: list[str], x: np.ndarray) -> pd.DataFrame:
    """Error of each penalty on the last fifth, fitted on the rest; the least is the choice, the first of equals."""
    z = (x - x.mean(0)) / np.maximum(x.std(0), 1e-12)
    d, cut = len(names), int(len(z) * 0.8)
    both = lambda r: np.hstack([r[1:], r[:-1]])
    fit, test = both(z[:cut]), both(z[cut:])
    rows = []
    for penalty in (0.01, 0.05, 0.1):
        m, a, _ = kernels.dynamic_graph(fit.T @ fit / len(fit), d, np.vstack([np.eye(d, dtype=bool), np.zeros((d, d), bool)]), penalty, penalty)
        rows.append((penalty, float(np.linalg.norm(test[:, :d] - test[:, :d] @ m - test[:, d:] @ a))))
    best = min(range(len(rows)), key=lambda i: rows[i][1])
    return pd.DataFrame([(w, p, e, i == best) for i, (p, e) in enumerate(rows)], columns=["w", "penalty", "error", "chosen"])


def bootstrap(spark: SparkSession, sf_dir: str, replicates: int = REPLICATES) -> DataFrame:
    """(lag, src, dst, prob, median) over the fitted windows and residual-bootstrap replicates, one small task each."""
    rolled = panel(spark, sf_dir).select("w", "r", "name", "v").withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot_table(index="r", columns="name", values="v").sort_index().dropna()
        if len(wide) < ROWS_PER_SERIES * wide.shape[1]:
            return pd.DataFrame(columns=["w", "lag", "src", "dst", "weight"])
        w, rep = int(pdf["w"].iloc[0]), int(pdf["rep"].iloc[0])
        b0, b1 = discovery.bootstrap_var_lingam(wide.to_numpy(), w * 100_003 + rep)
        # A row without names counts the group as fitted, whatever its edges.
        return pd.concat([pd.DataFrame([(w, -1, None, None, 1.0)], columns=["w", "lag", "src", "dst", "weight"]), tall(w, list(wide.columns), (0, b0), (1, b1))])

    found = rolled.groupBy("w", "rep").applyInPandas(run, EDGES)
    hits = found.filter(F.abs("weight") > 0.01).groupBy("lag", "src", "dst").agg(F.count(F.lit(1)).alias("n"), F.percentile("weight", 0.5).alias("median"))
    # The hits are at most one row a lag and pair of series, whatever the number of windows.
    total = F.max(F.when(F.col("lag") == -1, F.col("n"))).over(Window.partitionBy(F.lit(0)))
    return hits.withColumn("total", total).filter("lag >= 0").select("lag", "src", "dst", (F.col("n") / F.col("total")).alias("prob"), "median")


def permutation_null(spark: SparkSession, sf_dir: str, replicates: int = REPLICATES) -> DataFrame:
    """(w, name, score, threshold, p, selected): driver scores against scores on shuffled drivers.

    Each replicate shuffles every driver by itself; the threshold is the 95 %
    point of the replicates' largest scores, p the share of shuffled scores at
    least as large, with one added above and below.
    """

    def score(x: np.ndarray, a: np.ndarray) -> np.ndarray:
        z = (x - x.mean(0)) / np.maximum(x.std(0), 1e-12)
        lagged = np.abs(z[:-1, ~a].T @ z[1:, a] / (len(z) - 1))
        return (np.abs(z[:, ~a].T @ z[:, a] / len(z)) + lagged).sum(1)

    def kernel(w: int, names: list[str], x: np.ndarray) -> pd.DataFrame:
        a, rng = is_asset(names), np.random.default_rng(w)
        real, null = score(x, a), []
        for _ in range(replicates):
            shuffled = x.copy()
            shuffled[:, ~a] = rng.permuted(x[:, ~a], axis=0)
            null.append(score(shuffled, a))
        null = np.array(null)
        top = float(np.quantile(null.max(1), 0.95))
        p = ((null >= real).sum(0) + 1) / (replicates + 1)
        return pd.DataFrame({"w": w, "name": np.array(names)[~a], "score": real, "threshold": top, "p": p, "selected": real > top})

    return per_window(panel(spark, sf_dir), kernel, "w long, name string, score double, threshold double, p double, selected boolean")


def causal_scores(x: np.ndarray, names: list[str], max_rounds: int = 20, quantile: float = 0.9) -> np.ndarray:
    """Stage-A scores of the drivers from a graph fitted to the window: lagged effects on assets at or above their ``quantile``."""
    a, d = is_asset(names), len(names)
    z = (x - x.mean(0)) / np.maximum(x.std(0), 1e-12)
    both = np.hstack([z[1:], z[:-1]])
    block = np.outer(a, ~a)
    _, lagged, _ = kernels.dynamic_graph(both.T @ both / len(both), d, np.vstack([block | np.eye(d, dtype=bool), block]), max_rounds=max_rounds)
    effect = np.abs(lagged[np.ix_(~a, a)])
    found = effect[effect > 0]
    return np.where(effect >= np.quantile(found, quantile), effect, 0).sum(1) if len(found) else np.zeros(effect.shape[0])


def refitted_null(spark: SparkSession, sf_dir: str, replicates: int = REPLICATES, max_rounds: int = 8) -> DataFrame:
    """(w, rep, scores): stage-A scores of every window, and of ``replicates`` refits with each driver shuffled by itself; rep 0 is the real one.

    One small task a window and replicate; a fit that fails scores 0.
    """
    rows = panel(spark, sf_dir).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot_table(index="r", columns="name", values="v").sort_index().dropna()
        names, x = list(wide.columns), wide.to_numpy()
        if len(wide) < ROWS_PER_SERIES * wide.shape[1]:
            return pd.DataFrame(columns=["w", "rep", "scores"])
        w, rep = int(pdf["w"].iloc[0]), int(pdf["rep"].iloc[0])
        a = is_asset(names)
        if rep:
            x = x.copy()
            x[:, ~a] = np.random.default_rng(w * 100_003 + rep).permuted(x[:, ~a], axis=0)
        try:
            scores = causal_scores(x, names, max_rounds)
        except np.linalg.LinAlgError:
            scores = np.zeros(int((~a).sum()))
        return pd.DataFrame({"w": [w], "rep": [rep], "scores": [scores]})

    return rows.groupBy("w", "rep").applyInPandas(run, "w long, rep long, scores array<double>")


def calibrated(null: DataFrame) -> DataFrame:
    """(w, k_knee, k_null, k, sweep) from ``refitted_null``; a group is one window's replicates."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep")
        scores = np.stack(pdf["scores"].to_list())
        by_knee, by_null, k, sweep = kernels.calibrate_k(scores[0], scores[1:])
        return pd.DataFrame({"w": [int(pdf["w"].iloc[0])], "k_knee": [by_knee], "k_null": [by_null], "k": [k], "sweep": [sweep]})

    return null.groupBy("w").applyInPandas(run, "w long, k_knee long, k_null long, k long, sweep array<long>")


def dependence_summary(p_values: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(w, rejection_rate, min_p, median_p, n, warn) of pairwise p-values; ``warn`` above a rate of 0.2."""
    rate = F.avg(F.when(F.col("p") < alpha, 1.0).otherwise(0.0))
    known = p_values.filter(~F.isnan("p") & F.col("p").isNotNull())
    return known.groupBy("w").agg(rate.alias("rejection_rate"), F.min("p").alias("min_p"), F.percentile("p", F.lit(0.5)).alias("median_p"), F.count(F.lit(1)).alias("n"), (rate > 0.2).alias("warn"))


def dimensions(sensitivities: DataFrame) -> DataFrame:
    """(w, dimension): principal components that hold 95 % of a window's sensitivities (w, driver, asset, s)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        s = pdf.pivot_table(index="driver", columns="asset", values="s").to_numpy()
        return pd.DataFrame({"w": [int(pdf["w"].iloc[0])], "dimension": [kernels.effective_dimension(s)]})

    return sensitivities.groupBy("w").applyInPandas(run, "w long, dimension long")


def by_regime(fit, regimes: int = 3):
    """``fit(matrices, names)`` gives effects of each of the consecutive regimes of a window, for every window."""

    def kernel(w: int, names: list[str], x: np.ndarray) -> pd.DataFrame:
        bs = fit(np.array_split(x, regimes), names)
        return pd.concat([tall(w, names, (g, b)) for g, b in enumerate(bs)]).rename(columns={"lag": "regime"})

    return lambda spark, sf_dir: per_window(panel(spark, sf_dir), kernel, "w long, regime int, src string, dst string, weight double")


def _varma(w: int, names: list[str], x: np.ndarray) -> pd.DataFrame:
    """Effects of values (``of`` is value) and of past errors (error), by lag."""
    bs, omegas, _ = variants.varma_lingam(x, 2, 1, search=True)
    values = tall(w, names, *enumerate(bs)).assign(of="value")
    errors = tall(w, names, *enumerate(omegas, 1)).assign(of="error")
    return pd.concat([values, errors])[["w", "of", "lag", "src", "dst", "weight"]]


def _two_groups(x, names):
    """Drivers and assets as groups of variables."""
    a = is_asset(names)
    return [variants.group_direct_lingam(x, [list(np.flatnonzero(~a)), list(np.flatnonzero(a))])[0]]


def _with_signs(x, names):
    """Drivers as they are, assets as binary columns: up or not."""
    a = is_asset(names)
    return [variants.mixed_lingam(np.where(a, x > 0, x), ["binary" if k else "continuous" for k in a])]


def _factors(w: int, names: list[str], x: np.ndarray) -> pd.DataFrame:
    """One factor behind the drivers and one behind the assets, over two regimes as domains."""
    a = is_asset(names)
    bs, _ = variants.latent_lingam(np.array_split(x, 2), [list(np.flatnonzero(~a)), list(np.flatnonzero(a))])
    rows = [(w, g, s, t, float(b[i, j])) for g, b in enumerate(bs) for i, s in enumerate(("drivers", "assets")) for j, t in enumerate(("drivers", "assets")) if i != j]
    return pd.DataFrame(rows, columns=["w", "domain", "src", "dst", "weight"])


def _fit_indices(w: int, names: list[str], x: np.ndarray) -> pd.DataFrame:
    found = variants.fit_indices(x, kernels.direct_lingam(x)[0])
    return pd.DataFrame([(w, k, v) for k, v in found.items()], columns=["w", "measure", "value"])


def with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effects in each window of all its rows, those that some series lack included."""
    columns = [field.split()[0] for field in EDGES.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot_table(index="r", columns="name", values="v").sort_index()
        if len(wide.dropna()) < ROWS_PER_SERIES * wide.shape[1]:
            return pd.DataFrame(columns=columns)
        return tall(int(pdf["w"].iloc[0]), list(wide.columns), (0, variants.missing_lingam(wide.to_numpy())[0]))

    return panel(spark, sf_dir).select("w", "r", "name", "v").groupBy("w").applyInPandas(run, EDGES)


def longitudinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth row of a window is a subject's time point: effects per time and lag."""

    def kernel(w: int, names: list[str], x: np.ndarray) -> pd.DataFrame:
        n = len(x) // 4 * 4
        out = discovery.longitudinal_lingam([x[t:n:4] for t in range(4)])
        return pd.concat([tall(w, names, (lag, b)).assign(t=t) for t, lag, b in out])[["w", "t", "lag", "src", "dst", "weight"]]

    return per_window(panel(spark, sf_dir), kernel, "w long, t int, lag int, src string, dst string, weight double")


def largest_subgraphs(edges: DataFrame) -> DataFrame:
    """Edges of each window's connected part with most edges (ties: smallest name); a group is one window's graph."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        root: dict[str, str] = {}

        def find(n: str) -> str:
            while root.setdefault(n, n) != n:
                n = root[n]
            return n

        for a, b in zip(pdf["src"], pdf["dst"], strict=True):
            low, high = sorted((find(a), find(b)))
            root[high] = low
        part = pdf["src"].map(find)
        sizes = part.value_counts()
        return pdf[part == min(sizes.index, key=lambda n: (-sizes[n], n))]

    return edges.groupBy("w").applyInPandas(run, edges.schema)


def queries() -> dict:
    pair = "w long, a string, b string, p double"
    plain = lambda kernel, schema: lambda spark, sf_dir: per_window(panel(spark, sf_dir), kernel, schema)
    lingam = edges_query(lambda x, names: [kernels.direct_lingam(x)[0]])
    return {
        "ica_lingam": edges_query(lambda x, names: [discovery.ica_lingam(x)[0]]),
        "high_dim_lingam": edges_query(lambda x, names: [discovery.high_dim_lingam(x)[0]]),
        "bottom_up_parce": edges_query(lambda x, names: [discovery.bottom_up_parce(x)]),
        "rcd": edges_query(lambda x, names: [discovery.rcd(x, 1)]),
        "resit": edges_query(lambda x, names: [discovery.resit(x)]),
        "camuv": edges_query(lambda x, names: [discovery.camuv(x)]),
        "group_lingam": edges_query(_drivers_only(_groups_as_edges)),
        "parce_f_correlation": edges_query(_drivers_only(lambda x: discovery.bottom_up_parce(x, by_f_correlation=0.5))),
        "notears_nonlinear": edges_query(_nonlinear(0)),
        "notears_nonlinear_lagged": edges_query(_nonlinear(1)),
        "masked_var": edges_query(_masked),
        "total_effects": edges_query(lambda x, names: [discovery.total_effects(kernels.direct_lingam(x)[0])]),
        "multi_group_lingam": by_regime(lambda xs, names: discovery.multi_group_lingam(xs)[0]),
        "multi_group_rcd": by_regime(lambda xs, names: discovery.multi_group_rcd(xs, 1), 2),
        "multi_group_resit": by_regime(lambda xs, names: discovery.multi_group_resit(xs), 2),
        "multi_group_camuv": edges_query(lambda x, names: [discovery.multi_group_camuv(np.array_split(x, 2))]),
        "group_direct_lingam": edges_query(_two_groups),
        "varma_lingam": plain(_varma, "w long, of string, lag int, src string, dst string, weight double"),
        "missing_lingam": with_gaps,
        "mixed_lingam": edges_query(_with_signs),
        "latent_lingam": plain(_factors, "w long, domain int, src string, dst string, weight double"),
        "fit_indices": plain(_fit_indices, "w long, measure string, value double"),
        "longitudinal_lingam": longitudinal,
        "bootstrap_varlingam": bootstrap,
        "permutation_null": permutation_null,
        "driver_sensitivities": plain(_sensitivities, "w long, driver string, asset string, s double"),
        "causal_order": plain(_order, "w long, position long, name string"),
        "var_lag_order": plain(_lags, "w long, lags long"),
        "error_independence": plain(_errors, pair),
        "hsic_panel_summary": lambda spark, sf_dir: dependence_summary(plain(_errors, pair)(spark, sf_dir)),
        "calibrate_k": lambda spark, sf_dir: calibrated(refitted_null(spark, sf_dir)),
        "effective_dimension": lambda spark, sf_dir: dimensions(plain(_sensitivities, "w long, driver string, asset string, s double")(spark, sf_dir)),
        "intervention_means": plain(_effects, "w long, cause string, target string, raised double, lowered double"),
        "penalty_grid": plain(_split_error, "w long, penalty double, error double, chosen boolean"),
        "largest_subgraph": lambda spark, sf_dir: largest_subgraphs(lingam(spark, sf_dir)),
    }
