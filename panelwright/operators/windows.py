"""Panels and rolling windows as DataFrames, and kernels over them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels
from ..plans.catalogue import CATALOGUE
from ..plans.runs import rolled
from ..plans.sql import Tables
from ..sources.store import settle

#: Complete rows a window needs for each of its series; a thinner window gives no result rows.
ROWS_PER_SERIES = 2

EDGES = "w long, lag int, src string, dst string, weight double"


def per_window(rolled: DataFrame, kernel: Callable[[int, list[str], np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """``kernel(window, names, matrix)`` for each window; the matrix has the rows all series share, in order.

    A group is one window, whose size is fixed by its width, not by the table.
    Windows thinner than ROWS_PER_SERIES are left out; rows that repeat a series in a row are averaged.
    """
    columns = [field.split()[0] for field in schema.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot_table(index="r", columns="name", values="v").sort_index().dropna()
        if len(wide) < ROWS_PER_SERIES * wide.shape[1]:
            return pd.DataFrame(columns=columns)
        return kernel(int(pdf["w"].iloc[0]), list(wide.columns), wide.to_numpy())

    return rolled.select("w", "r", "name", "v").groupBy("w").applyInPandas(run, schema)


def _tall(w: int, names: list[str], *lags: tuple[int, np.ndarray]) -> pd.DataFrame:
    rows = [(w, lag, names[i], names[j], float(m[i, j])) for lag, m in lags for i, j in zip(*np.nonzero(m), strict=True)]
    return pd.DataFrame(rows, columns=["w", "lag", "src", "dst", "weight"])


def _fit_dynamic(lags: int, threshold: float):
    def kernel(w: int, names: list[str], x: np.ndarray) -> pd.DataFrame:
        z = (x - x.mean(0)) / np.maximum(x.std(0), 1e-12)
        d = len(names)
        both = np.hstack([z[lags - k : len(z) - k] for k in range(lags + 1)])
        asset = np.array([n.startswith("A") for n in names])
        block = np.outer(asset, ~asset)  # assets do not drive drivers
        forbidden = np.vstack([block | np.eye(d, dtype=bool), *[block] * lags])
        m, a, _ = kernels.dynamic_graph(both.T @ both / len(both), d, forbidden, threshold=threshold)
        return _tall(w, names, (0, m), *((k + 1, a[k * d : (k + 1) * d]) for k in range(lags)))

    return kernel


def _fit_var_lingam(w: int, names: list[str], x: np.ndarray) -> pd.DataFrame:
    *b, _ = kernels.var_lingam(x, 2, "bic", prune=True)
    return _tall(w, names, *enumerate(b))


def _fit_joint_var_lingam(w: int, names: list[str], x: np.ndarray) -> pd.DataFrame:
    """Assets lead to no driver: not in the regression, not in the order, not in the effects."""
    asset = np.array([n.startswith("A") for n in names])
    block = np.outer(asset, ~asset)
    *b, _ = kernels.var_lingam(x, 1, known=np.where(block, 0, -1), allowed=~block)
    return _tall(w, names, *enumerate(b))


def _fit_lingam(w: int, names: list[str], x: np.ndarray) -> pd.DataFrame:
    return _tall(w, names, (0, kernels.direct_lingam(x)[0]))


def _weights(method: str, linkage: str = "single", cap: float | None = None):
    def kernel(w: int, names: list[str], x: np.ndarray) -> pd.DataFrame:
        assets = [i for i, n in enumerate(names) if n.startswith("A")]
        x = x[:, assets]
        cov = kernels.shrunk_covariance(x) if method.endswith("shrunk") else np.cov(x.T)
        if method == "causal":
            effects = kernels.direct_lingam(x)[0]
            out = kernels.hierarchical_weights(kernels.nearest_psd(kernels.structural_covariance(effects, np.diag(np.diag(cov)))), kernels.causal_distance(effects), linkage)
        elif method.startswith("hrp"):
            out = kernels.hierarchical_weights(cov, np.sqrt(np.maximum(0.5 * (1 - np.corrcoef(x.T)), 0)), linkage)
        else:
            out = kernels.simplex_weights(cov, x.mean(0) if method == "mean_variance" else None, 5.0, cap)
        return pd.DataFrame({"w": w, "name": [names[i] for i in assets], "weight": out})

    return kernel


def compare_weights(first: DataFrame, second: DataFrame) -> DataFrame:
    """(w, distance, overlap): half the absolute difference of two weight tables (w, name, weight), and the sum of the smaller ones."""
    both = first.select("w", "name", F.col("weight").alias("x")).join(second.select("w", "name", F.col("weight").alias("y")), ["w", "name"], "full").na.fill(0.0, ["x", "y"])
    return both.groupBy("w").agg((0.5 * F.sum(F.abs(F.col("x") - F.col("y")))).alias("distance"), F.sum(F.least("x", "y")).alias("overlap"))


def _stationarity(w: int, names: list[str], x: np.ndarray) -> pd.DataFrame:
    adf, kpss = [kernels.adf_test(c) for c in x.T], [kernels.kpss_test(c) for c in x.T]
    out = {"w": w, "name": names, "adf": [t[0] for t in adf], "adf_p": [t[1] for t in adf], "adf_lags": [t[2] for t in adf], "kpss": [t[0] for t in kpss], "kpss_p": [t[1] for t in kpss]}
    return pd.DataFrame(out).assign(both_fail=[a[1] >= 0.05 and k[1] < 0.05 for a, k in zip(adf, kpss, strict=True)])


def stationary(series: DataFrame, alpha: float = 0.01, key: str = "name", at: str = "r", value: str = "v") -> DataFrame:
    """``series`` without those whose ADF p-value is ``alpha`` or more, or not defined; a group is one series."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = kernels.adf_test(pdf.sort_values(at)[value].dropna().to_numpy(float))[1]
        return pd.DataFrame({key: [pdf[key].iloc[0]], "p": [p]})

    kind = series.schema[key].dataType.simpleString()
    kept = series.select(key, at, value).groupBy(key).applyInPandas(run, f"`{key}` {kind}, p double").filter(f"p < {alpha}")
    return series.join(F.broadcast(kept.select(key)), key, "left_semi")


def _greedy(w: int, names: list[str], x: np.ndarray) -> pd.DataFrame:
    drivers = [i for i, n in enumerate(names) if n.startswith("D")]
    steps = kernels.greedy_drivers(x[:-1][:, drivers], x[1:][:, [i for i in range(len(names)) if i not in drivers]], 3)
    return pd.DataFrame([(w, k + 1, names[drivers[j]], gain) for k, (j, gain) in enumerate(steps)], columns=["w", "step", "name", "gain"])


def _dependence(w: int, names: list[str], x: np.ndarray) -> pd.DataFrame:
    rows = [(w, a, names[j], kernels.hsic(x[:, i], x[:, j])) for i, a in enumerate(names) for j in range(i + 1, len(names))]
    return pd.DataFrame(rows, columns=["w", "a", "b", "hsic"])


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(w, r, name, v): the rolled weekly return panel."""
    return rolled(Tables(CATALOGUE, spark, sf_dir)).select("w", "r", "name", "v")


def _query(kernel, schema: str):
    return lambda spark, sf_dir: per_window(panel(spark, sf_dir), kernel, schema)


def queries() -> dict:
    weights = "w long, name string, weight double"
    return {
        "dynotears_windows": _query(_fit_dynamic(1, 0.05), EDGES),
        "notears": _query(_fit_dynamic(0, 0.05), EDGES),
        "varlingam_windows": _query(_fit_var_lingam, EDGES),
        "direct_lingam": _query(_fit_lingam, EDGES),
        "hrp_weights": _query(_weights("hrp"), weights),
        "hrp_weights_shrunk": _query(_weights("hrp_shrunk"), weights),
        "min_variance": _query(_weights("min_variance"), weights),
        "mean_variance": _query(_weights("mean_variance"), weights),
        "stage_b_greedy": _query(_greedy, "w long, step long, name string, gain double"),
        "hrp_average": _query(_weights("hrp", "average"), weights),
        "hrp_complete": _query(_weights("hrp", "complete"), weights),
        "hrp_ward": _query(_weights("hrp", "ward"), weights),
        "hrp_causal": _query(_weights("causal"), weights),
        "min_variance_capped": _query(_weights("min_variance", cap=0.2), weights),
        "compare_hrp": lambda spark, sf_dir: compare_weights(*(per_window(settle(panel(spark, sf_dir), "rolled"), _weights(m), weights) for m in ("hrp", "causal"))),
        "joint_varlingam": _query(_fit_joint_var_lingam, EDGES),
        "adf_kpss": _query(_stationarity, "w long, name string, adf double, adf_p double, adf_lags long, kpss double, kpss_p double, both_fail boolean"),
        "stationary_series": lambda spark, sf_dir: stationary(Tables(CATALOGUE, spark, sf_dir).kept("panel")).groupBy("name").agg(F.count(F.lit(1)).alias("n")),
        "hsic_pairs": _query(_dependence, "w long, a string, b string, hsic double"),
    }
