"""Walk-forward portfolios whose driver selection learns from realised credit.

The graph and the network of a window do not depend on the loop, so every
window is fitted in its own task; what is left, a fold over the windows in
order, is light and runs once per variant.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels, neural
from ..plans.fixtures import STEP
from .discovery import causal_scores, is_asset
from .windows import panel, per_window

FITTED = "w long, drivers array<string>, assets array<string>, x array<double>, plain array<double>, causal array<double>, s array<double>"
RESULT = "variant string, w long, drivers string, gross double, turnover double, net double, reward double"
#: Windows in which the causal score stands alone, drivers held, weight of the causal score, memory of the utility, cost.
BURN_IN, K, ALPHA, GAMMA, BPS = 6, 1, 0.7, 0.3, 5.0
#: With five drivers the top tenth of the effects would leave two of them, and the blend nothing to choose.
QUANTILE = 0.5


def zscore(v: np.ndarray) -> np.ndarray:
    s = v.std()
    return np.zeros_like(v) if s < 1e-12 else (v - v.mean()) / s


def fit(w: int, names: list[str], x: np.ndarray) -> pd.DataFrame:
    """A window's driver scores (correlation, causal) and sensitivities, with its rows for the fold; none if it has too few."""
    a = is_asset(names)
    if len(x) < neural.MIN_ROWS + 1 or a.all() or a.sum() < 2:
        return pd.DataFrame(columns=["w", "drivers", "assets", "x", "plain", "causal", "s"])
    z = (x - x.mean(0)) / np.maximum(x.std(0), 1e-12)
    causal = causal_scores(x, names, 8, QUANTILE)
    plain = np.abs(z[:, ~a].T @ z[:, a] / len(z)).sum(1) + np.abs(z[:-1, ~a].T @ z[1:, a] / (len(z) - 1)).sum(1)
    s = neural.sensitivities(z[:, ~a], z[:, a])
    keep = np.concatenate([np.flatnonzero(~a), np.flatnonzero(a)])
    return pd.DataFrame({"w": [w], "drivers": [[names[i] for i in keep if not a[i]]], "assets": [[names[i] for i in keep if a[i]]], "x": [x[:, keep].ravel()], "plain": [plain], "causal": [causal], "s": [s.ravel()]})


def _sharpe(v: np.ndarray) -> float:
    return 0.0 if len(v) == 0 or v.std() < 1e-12 else float(np.sqrt(52) * v.mean() / v.std())


def fold(variant: str, fitted: pd.DataFrame, step: int = STEP, held_drivers: int = K, burn_in: int = BURN_IN) -> pd.DataFrame:
    """Windows in order: pick drivers, weigh assets, hold to the next window's end, credit the drivers.

    The pool has twice as many drivers as are held, so the blend matters only
    where more than that score.  ``v0`` scores by correlation, ``v1`` by the graph, ``v2`` blends the graph
    with the utility of earlier credits.  A window's credit is known only once
    the next one has closed, so it first counts in the window after that.
    """
    rows = fitted.sort_values("w").to_dict("records")
    utility: dict[str, float] = {}
    waiting: dict[str, float] | None = None
    before: dict[str, float] = {}
    out = []
    for k, (now, after) in enumerate(zip(rows, rows[1:], strict=False)):
        drivers, assets = list(now["drivers"]), list(now["assets"])
        x = np.asarray(now["x"]).reshape(-1, len(drivers) + len(assets))
        s = np.asarray(now["s"]).reshape(len(drivers), -1)
        base = np.asarray(now["plain" if variant == "v0" else "causal"], float)
        blended = base
        if variant == "v2" and k >= burn_in:
            blended = ALPHA * zscore(base) + (1 - ALPHA) * zscore(np.array([utility.get(n, 0.0) for n in drivers]))
        ranked = sorted((i for i in range(len(drivers)) if base[i] > 0), key=lambda i: (-blended[i], drivers[i]))
        if variant == "v0":
            chosen = ranked[:held_drivers]
        else:
            pool = ranked[: 2 * held_drivers]
            picked = kernels.greedy_drivers(x[:-1][:, pool], x[1:][:, len(drivers) :], held_drivers) if pool else []
            chosen = [pool[j] for j, _ in picked] or pool[:held_drivers]
        returns = x[:, len(drivers) :]
        cov = np.cov(returns.T)
        if chosen:
            part = s[chosen]
            dist = np.sqrt(((part[:, :, None] - part[:, None, :]) ** 2).sum(0))
        else:
            dist = np.sqrt(np.maximum(0.5 * (1 - np.corrcoef(returns.T)), 0))
        weight = dict(zip(assets, kernels.hierarchical_weights(cov, dist), strict=True))
        both = list(after["drivers"]) + list(after["assets"])
        held = np.exp(np.asarray(after["x"]).reshape(-1, len(both))[-step:]) - 1
        at = {n: held[:, both.index(n)] for n in after["assets"]}
        gross = sum((weight[n] * at[n] for n in assets if n in at), np.zeros(len(held)))
        equal = np.mean([at[n] for n in at], axis=0)
        turnover = 0.5 * sum(abs(weight.get(n, 0.0) - before.get(n, 0.0)) for n in weight.keys() | before.keys())
        net = gross.copy()
        net[:1] -= turnover * BPS / 1e4
        reward = _sharpe(net) - _sharpe(equal)
        if waiting is not None:
            for n, c in waiting.items():
                utility[n] = GAMMA * c + (1 - GAMMA) * utility.get(n, 0.0)
        influence = {drivers[i]: float(np.abs(np.array([weight[n] for n in assets]) * s[i]).sum()) for i in chosen}
        total = sum(influence.values())
        waiting = {n: reward * v / total if total > 1e-12 else 0.0 for n, v in influence.items()}
        before = weight
        out.append((variant, int(now["w"]), ",".join(drivers[i] for i in chosen), float(np.prod(1 + gross) - 1), turnover, float(np.prod(1 + net) - 1), reward))
    return pd.DataFrame(out, columns=["variant", "w", "drivers", "gross", "turnover", "net", "reward"])


def closed_loop(rolled: DataFrame) -> DataFrame:
    """(variant, w, ...) of v0, v1 and v2 over (w, r, name, v): parallel fits, then one fold per variant.

    A fold's group holds one compact row per window: its size grows with the
    calendar and the panel's width, not with the rows that prices came from.
    """
    fitted = per_window(rolled, fit, FITTED)
    variants = F.explode(F.array(*(F.lit(v) for v in ("v0", "v1", "v2"))))
    return fitted.withColumn("variant", variants).groupBy("variant").applyInPandas(lambda pdf: fold(str(pdf["variant"].iloc[0]), pdf), RESULT)


def queries() -> dict:
    return {"closed_loop": lambda spark, sf_dir: closed_loop(panel(spark, sf_dir))}
