"""Dependence tests and tail probabilities in numpy."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np


def gamma_sf(a: float, x: float) -> float:
    """Upper tail of the standard gamma distribution: a power series below the mean, a continued fraction above."""
    if not (a > 0 and math.isfinite(x)):
        return float("nan")
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while term > total * 1e-15:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - total * scale)
    value = 0.0  # backward evaluation: 1 / (x + 1 - a - 1(1 - a) / (x + 3 - a - ...))
    for k in range(400, 0, -1):
        value = k * (k - a) / (x + 2 * k + 1 - a - value)
    return min(1.0, scale / (x + 1 - a - value))


def chi2_sf(x: float, k: float) -> float:
    return gamma_sf(k / 2, x / 2)


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _centred_gram(x: np.ndarray) -> tuple[np.ndarray, float]:
    x = x.reshape(len(x), -1)
    d = ((x[:, None] - x[None, :]) ** 2).sum(-1)
    near = d[:100, :100]
    width = np.median(near[near > 0]) if (near > 0).any() else 1.0
    k = np.exp(-d / width)
    n = len(k)
    return k - k.mean(0) - k.mean(1)[:, None] + k.mean(), float(k.sum() - np.trace(k)) / (n * (n - 1))


def hsic_test(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(statistic, p): HSIC with median-distance Gaussian kernels, gamma-approximated null; nan below 6 rows."""
    n = len(x)
    if n < 6:
        return float("nan"), float("nan")
    (k, mk), (m, mm) = _centred_gram(x), _centred_gram(y)
    stat = float((k * m).sum()) / n
    sq = (k * m / 6) ** 2
    var = float(sq.sum() - np.trace(sq)) / (n * (n - 1)) * 72 * (n - 4) * (n - 5) / (n * (n - 1) * (n - 2) * (n - 3))
    mean = (1 + mk * mm - mk - mm) / n
    if var <= 0 or mean <= 0:
        return stat, 1.0
    return stat, gamma_sf(mean * mean / var, stat * mean / (var * n))


def fisher_p(ps: list[float]) -> tuple[float, float]:
    """Fisher's combination of p-values: (statistic, p)."""
    stat = -2 * sum(math.log(max(p, 1e-300)) for p in ps)
    return stat, chi2_sf(stat, 2 * len(ps))


def correlation_p(x: np.ndarray, y: np.ndarray) -> float:
    """Two-sided p of a Pearson correlation by Fisher's z."""
    sx, sy = x.std(), y.std()
    if sx < 1e-12 or sy < 1e-12 or len(x) < 4:
        return 1.0
    r = float(np.clip(((x - x.mean()) * (y - y.mean())).mean() / (sx * sy), -0.9999999, 0.9999999))
    return 2 * normal_sf(abs(math.atanh(r)) * math.sqrt(len(x) - 3))


def normality_p(x: np.ndarray) -> float:
    """p of the Shapiro-Francia test, by Royston's normal approximation (1993); 1 for a constant or below 5 rows."""
    n = len(x)
    if n < 5 or x.std() < 1e-12:
        return 1.0
    m = np.array([NormalDist().inv_cdf((i + 0.625) / (n + 0.25)) for i in range(n)])
    u = math.log(n)
    v = math.log(u)
    # The approximation's coefficients.
    mean, sd = -1.2725 + 1.0521 * (v - u), 1.0308 - 0.26758 * (v + 2 / u)
    return normal_sf((math.log(max(1 - np.corrcoef(np.sort(x), m)[0, 1] ** 2, 1e-300)) - mean) / sd)


def incomplete_cholesky(x: np.ndarray, sigma: float, tolerance: float) -> np.ndarray:
    """G with GG' close to the Gaussian Gram matrix of ``x``: greedy pivots until the trace left is below tolerance."""
    n = len(x)
    left, columns = np.ones(n), []
    while left.sum() > tolerance and len(columns) < n:
        i = int(np.argmax(left))
        if left[i] <= 1e-14:
            break
        c = np.exp(-((x - x[i]) ** 2) / (2 * sigma * sigma))
        for g in columns:
            c = c - g * g[i]
        c = c / math.sqrt(left[i])
        columns.append(c)
        left = np.maximum(left - c * c, 0)
    return np.column_stack(columns)


def f_correlation(x: np.ndarray, y: np.ndarray) -> float:
    """First regularised kernel canonical correlation (Bach and Jordan 2002)."""
    n = len(x)
    kappa, sigma = (2e-3, 0.5) if n > 1000 else (2e-2, 1.0)
    parts = []
    for v in (x, y):
        g = incomplete_cholesky((v - v.mean()) / max(v.std(), 1e-12), sigma, n * kappa * 1e-2)
        u, s, _ = np.linalg.svd(g - g.mean(0), full_matrices=False)
        s = s * s
        parts.append(u * (s / (s + n * kappa / 2)))
    return float(np.linalg.norm(parts[0].T @ parts[1], 2))


def f_correlation_of_any(x: np.ndarray, rest: np.ndarray) -> float:
    return max(f_correlation(x, c) for c in rest.T)
