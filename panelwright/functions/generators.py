"""Random graphs and data from structural equations, for tests and calibration."""

from __future__ import annotations

import numpy as np


def random_dag(d: int, degree: float, kind: str = "erdos", low: float = 0.5, high: float = 2.0, seed: int = 0) -> np.ndarray:
    """M[i, j]: an acyclic graph under a random relabelling, weights uniform in +-[low, high].

    Kinds: ``erdos`` (each pair alike), ``scale-free`` (preferential attachment), ``full``.
    """
    rng = np.random.default_rng(seed)
    a = np.zeros((d, d), bool)
    if kind == "erdos":
        a = np.triu(rng.random((d, d)) < min(1.0, degree / max(d - 1, 1)), 1)
    elif kind == "scale-free":
        m, links = max(1, round(degree / 2)), np.ones(d)
        for j in range(1, d):
            chosen = rng.choice(j, size=min(m, j), replace=False, p=links[:j] / links[:j].sum())
            a[chosen, j] = True
            links[chosen] += 1
    elif kind == "full":
        a = np.triu(np.ones((d, d), bool), 1)
    else:
        raise ValueError(f"unknown kind {kind!r}")
    w = a * rng.uniform(low, high, (d, d)) * rng.choice([-1, 1], (d, d))
    p = rng.permutation(d)
    return w[np.ix_(p, p)]


def noise(rng: np.random.Generator, family: str, size: tuple[int, ...]) -> np.ndarray:
    draw = {"gaussian": rng.normal, "laplace": rng.laplace, "exponential": rng.exponential, "gumbel": rng.gumbel, "uniform": lambda size: rng.uniform(-1, 1, size), "student": lambda size: rng.standard_t(3, size)}
    if family not in draw:
        raise ValueError(f"unknown noise {family!r}")
    return draw[family](size=size)


def parents_first(w: np.ndarray) -> list[int]:
    left, order = set(range(len(w))), []
    while left:
        free = sorted(j for j in left if not any(w[i, j] for i in left))
        if not free:
            raise ValueError("the graph has a cycle")
        order += free
        left -= set(free)
    return order


def sem_data(w: np.ndarray, n: int, kinds: list[str] | None = None, family: str = "gaussian", scale: float = 1.0, intercept: float = 0.0, nonlinear: bool = False, seed: int = 0) -> np.ndarray:
    """Rows of a structural equation model; columns are continuous, binary, count or categorical:K (0 .. K - 1).

    Nonlinear effects pass each parent through a random smooth function (a sum of
    eight cosine features, which approximates a draw from a Gaussian process).
    """
    rng = np.random.default_rng(seed)
    d = len(w)
    kinds = kinds or ["continuous"] * d
    x = np.zeros((n, d))
    for j in parents_first(w):
        eta = np.full(n, intercept)
        for i in np.flatnonzero(w[:, j]):
            v = x[:, i]
            if nonlinear:
                f, phase, a = rng.normal(size=8), rng.uniform(0, 2 * np.pi, 8), rng.normal(size=8)
                v = np.sqrt(2 / 8) * np.cos(np.outer(v, f) + phase) @ a
            eta += w[i, j] * v
        if kinds[j] == "continuous":
            x[:, j] = eta + scale * noise(rng, family, (n,))
        elif kinds[j] == "binary":
            x[:, j] = rng.random(n) < 1 / (1 + np.exp(-np.clip(eta, -30, 30)))
        elif kinds[j] == "count":
            x[:, j] = rng.poisson(np.exp(np.clip(eta, -5, 5)))
        elif kinds[j].startswith("categorical:"):
            k = int(kinds[j].split(":")[1])
            utility = np.outer(eta, rng.normal(size=k)) + rng.gumbel(size=(n, k))
            x[:, j] = utility.argmax(1)
        else:
            raise ValueError(f"unknown column type {kinds[j]!r}")
    return x


def stationary_series(w: np.ndarray, lagged: list[np.ndarray], n: int, family: str = "gaussian", scale: float = 1.0, burn: int = 100, seed: int = 0, tries: int = 20) -> np.ndarray:
    """A vector autoregression with instantaneous effects; regrown with halved lagged effects while it explodes."""
    back = np.linalg.inv(np.eye(len(w)) - w)
    for attempt in range(tries):
        rng = np.random.default_rng(seed + attempt)
        e = scale * noise(rng, family, (n + burn, len(w)))
        x = np.zeros_like(e)
        with np.errstate(over="ignore", invalid="ignore"):
            for t in range(len(x)):
                past = sum((x[t - k - 1] @ a / 2.0**attempt for k, a in enumerate(lagged) if t > k), np.zeros(len(w)))
                x[t] = (past + e[t]) @ back
        if np.isfinite(x).all() and np.abs(x).max() < 1e3:
            return x[burn:]
    raise ValueError("no stationary series found")
