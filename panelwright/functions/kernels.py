"""Small dense solvers in numpy: one call per window, group or replicate.  No Spark here.

Matrices are oriented M[i, j] = effect of i on j throughout.
"""

from __future__ import annotations

import math

import numpy as np


def expm(a: np.ndarray) -> np.ndarray:
    """Matrix exponential: scaling, a Taylor sum, squaring."""
    squarings = max(0, int(np.ceil(np.log2(max(np.abs(a).sum(1).max(), 1e-16)))) + 4)
    x = a / 2.0**squarings
    term = out = np.eye(len(a))
    for k in range(1, 14):
        term = term @ x / k
        out = out + term
    for _ in range(squarings):
        out = out @ out
    return out


def acyclicity(w: np.ndarray) -> tuple[float, np.ndarray]:
    """h(W) = tr exp(W*W) - d and its gradient."""
    e = expm(w * w)
    return float(np.trace(e) - len(w)), 2 * w * e.T


def dynamic_graph(moments: np.ndarray, d: int, forbidden: np.ndarray, l_w: float = 0.05, l_a: float = 0.05, max_rounds: int = 20, threshold: float = 0.0) -> tuple[np.ndarray, np.ndarray, bool]:
    """(W, A, converged) minimising 1/2 tr(T' M T) + l1 penalties subject to h(W) = 0, T = [I - W; -A].

    ``moments`` is Z'Z/n of Z = [X | lagged X]; rows of the data never come here.
    An augmented Lagrangian drives h to zero; each round is a proximal gradient
    descent with backtracking, forbidden entries being held at zero.
    """
    size = len(moments)
    theta = np.zeros((size, d))
    penalty = np.vstack([np.full((d, d), l_w), np.full((size - d, d), l_a)])
    base = np.vstack([np.eye(d), np.zeros((size - d, d))])

    def smooth(t, rho, alpha):
        r = base - t
        mr = moments @ r
        h, dh = acyclicity(t[:d])
        g = -mr
        g[:d] += (alpha + rho * h) * dh
        return 0.5 * float((r * mr).sum()) + alpha * h + 0.5 * rho * h * h, g, h

    rho, alpha, h_old = 1.0, 0.0, np.inf
    for _ in range(max_rounds):
        step = 1.0 / max(np.linalg.norm(moments, 2), 1e-9)
        f, g, h = smooth(theta, rho, alpha)
        for _ in range(200):
            while True:
                t = theta - step * g
                t = np.sign(t) * np.maximum(np.abs(t) - step * penalty, 0)
                t[forbidden] = 0
                f_new, g_new, h_new = smooth(t, rho, alpha)
                move = t - theta
                if f_new <= f + float((g * move).sum()) + float((move * move).sum()) / (2 * step) + 1e-12 or step < 1e-12:
                    break
                step /= 2
            theta, f, g, h = t, f_new, g_new, h_new
            if np.abs(move).max() < 1e-5:
                break
            step *= 1.5
        if h <= 1e-8:
            break
        alpha += rho * h
        if h > 0.25 * h_old:
            rho *= 10
        h_old = h
        if rho > 1e16:
            break
    theta = np.where(np.abs(theta) < threshold, 0, theta)
    return break_cycles(theta[:d]), theta[d:], h <= 1e-6


def break_cycles(w: np.ndarray) -> np.ndarray:
    """Zero the weakest edge of a cycle until there is none."""
    w = w.copy()
    while (cycle := find_cycle(w != 0)) is not None:
        edges = list(zip(cycle, [*cycle[1:], cycle[0]], strict=True))
        w[min(edges, key=lambda e: (abs(w[e]), e))] = 0
    return w


def find_cycle(a: np.ndarray) -> list[int] | None:
    """Peel nodes without parents; in what is left, walk parents until one repeats."""
    alive = np.ones(len(a), bool)
    while True:
        free = alive & ~(a & alive[:, None]).any(0)
        if not free.any():
            break
        alive &= ~free
    if not alive.any():
        return None
    path = [int(np.flatnonzero(alive)[0])]
    while True:
        parent = int(np.flatnonzero(a[:, path[-1]] & alive)[0])
        if parent in path:
            return path[path.index(parent) :][::-1]
        path.append(parent)


def _entropy(u: np.ndarray) -> np.ndarray:
    """Maximum-entropy approximation of differential entropy (Hyvarinen 1998), columnwise."""
    # Constants of the approximation.
    k1, k2, gamma = 79.047, 7.4129, 0.37457
    return (1 + math.log(2 * math.pi)) / 2 - k1 * (np.log(np.cosh(u)).mean(0) - gamma) ** 2 - k2 * (u * np.exp(-u * u / 2)).mean(0) ** 2


def pairwise_gain(x: np.ndarray) -> np.ndarray:
    """G[i, j]: mutual information saved by i -> j over j -> i; columns are centred."""
    z = x / np.maximum(x.std(0), 1e-12)
    rho = z.T @ z / len(z)
    single = _entropy(z)
    gain = np.zeros(rho.shape)
    for i in range(len(rho)):
        scale = np.sqrt(np.maximum(1 - rho[i] ** 2, 1e-12))
        forward = _entropy((z - np.outer(z[:, i], rho[i])) / scale)
        backward = _entropy((z[:, [i]] - z * rho[i]) / scale)
        gain[i] = (single + backward) - (single[i] + forward)
    np.fill_diagonal(gain, 0)
    return gain


def causal_order(x: np.ndarray, known: np.ndarray | None = None) -> list[int]:
    """DirectLiNGAM: repeatedly take the variable most independent of the residuals of the others on it.

    ``known[i, j]`` is 1 where i is known to lead to j, 0 where it does not, -1
    where nothing is known.  A variable with a known cause among those left has
    to wait; if some are known to have none among them, one of these is taken.
    """
    x = x - x.mean(0)
    left, order = list(range(x.shape[1])), []
    while len(left) > 1:
        own = _may_lead(left, known)
        score = -(np.minimum(0, pairwise_gain(x[:, left])) ** 2).sum(1)
        m = left[max(own, key=lambda k: (score[k], -k))]
        order.append(m)
        left.remove(m)
        slope = x[:, left].T @ x[:, m] / max(float(x[:, m] @ x[:, m]), 1e-12)
        x = x.copy()
        x[:, left] -= np.outer(x[:, m], slope)
    return order + left


def _may_lead(left: list[int], known: np.ndarray | None) -> list[int]:
    """Places in ``left`` of the variables that may come next."""
    every = list(range(len(left)))
    if known is None:
        return every
    causes = [[known[i, j] for i in left if i != j] for j in left]
    free = [k for k in every if 1 not in causes[k]] or every
    return [k for k in free if all(c == 0 for c in causes[k])] or free


def prior_knowledge(names: list[str], exogenous: list[str] = (), sinks: list[str] = (), paths: list[tuple[str, str]] = (), no_paths: list[tuple[str, str]] = ()) -> np.ndarray:
    """Matrix of -1 (unknown), 0 and 1 from variables without causes, without effects, and pairs (from, to)."""
    at = {n: i for i, n in enumerate(names)}
    out = np.full((len(names),) * 2, -1)
    for a, b in no_paths:
        out[at[a], at[b]] = 0
    for a, b in paths:
        out[at[a], at[b]] = 1
    for n in exogenous:
        out[:, at[n]] = 0
    for n in sinks:
        out[at[n], :] = 0
    np.fill_diagonal(out, -1)
    return out


def lasso_path(gram: np.ndarray, xy: np.ndarray) -> list[tuple[float, np.ndarray]]:
    """(penalty, coefficients) at every knot of 1/2 b'Gb - xy'b + penalty |b|_1, from the largest penalty to 0."""
    k = len(xy)
    b, active, sign = np.zeros(k), [], np.zeros(k)
    lam = float(np.abs(xy).max(initial=0))
    out = [(lam, b.copy())]
    entering = int(np.argmax(np.abs(xy))) if k else -1
    dropped = -1
    for _ in range(8 * k):
        if lam <= 1e-12 * max(out[0][0], 1e-300):
            break
        c = xy - gram @ b
        if entering >= 0:
            active.append(entering)
            sign[entering] = np.sign(c[entering])
        u = np.linalg.lstsq(gram[np.ix_(active, active)], sign[active], rcond=None)[0]
        a = gram[:, active] @ u
        step, entering, leaving = lam, -1, -1
        for i in range(k):
            if i in active:
                continue
            for side, top, bottom in ((1, lam - c[i], 1 - a[i]), (-1, lam + c[i], 1 + a[i])):
                if i == dropped and side == sign[i]:
                    continue
                if bottom > 1e-12 and -1e-12 < top / bottom < step:
                    step, entering = max(top / bottom, 0.0), i
        for i, v in zip(active, u, strict=True):
            if v * b[i] < 0 and -b[i] / v < step:
                step, entering, leaving = -b[i] / v, -1, i
        b[active] += step * u
        lam -= step
        dropped = leaving
        if leaving >= 0:
            b[leaving] = 0.0
            active.remove(leaving)
        out.append((lam, b.copy()))
        if not active and entering < 0:
            break
    return out


def adaptive_lasso(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Lasso path on columns scaled by their least-squares slopes, least BIC among its knots, refit on the support."""
    n, k = x.shape
    if not k:
        return np.zeros(0)
    x, y = x - x.mean(0), y - y.mean()
    ols = np.linalg.lstsq(x, y, rcond=None)[0]
    z = x * np.abs(ols)
    noise = max(float(((y - x @ ols) ** 2).sum()) / max(n - k, 1), 1e-300)
    best, support = np.inf, np.zeros(k, bool)
    for _, b in lasso_path(z.T @ z / n, z.T @ y / n):
        bic = float(((y - z @ b) ** 2).sum()) / noise + math.log(n) * (b != 0).sum()
        if bic < best:
            best, support = bic, b != 0
    out = np.zeros(k)
    if support.any():
        out[support] = np.linalg.lstsq(x[:, support], y, rcond=None)[0]
    return out


def direct_lingam(x: np.ndarray, known: np.ndarray | None = None) -> tuple[np.ndarray, list[int]]:
    """(B, order); effects that ``known`` rules out stay 0."""
    order = causal_order(x, known)
    b = np.zeros((x.shape[1],) * 2)
    for k, j in enumerate(order):
        use = [i for i in order[:k] if known is None or known[i, j] != 0]
        b[use, j] = adaptive_lasso(x[:, use], x[:, j])
    return b, order


def lagged_blocks(x: np.ndarray, lags: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows from ``lags`` on, the ``lags`` rows before each side by side)."""
    return x[lags:], np.hstack([x[lags - k : len(x) - k] for k in range(1, lags + 1)])


def var_order(x: np.ndarray, most: int, criterion: str = "bic") -> int:
    """Order 1..most of a vector autoregression with the least AIC, BIC, HQIC or FPE; ties go to the smaller."""
    x = x - x.mean(0)
    best = (math.inf, 1)
    for p in range(1, most + 1):
        now, past = lagged_blocks(x[most - p :], p)
        n, k = now.shape
        e = now - past @ np.linalg.lstsq(past, now, rcond=None)[0]
        _, logdet = np.linalg.slogdet(e.T @ e / n)
        free = p * k * k / n
        value = {"aic": logdet + 2 * free, "bic": logdet + math.log(n) * free, "hqic": logdet + 2 * math.log(math.log(n)) * free, "fpe": logdet + k * math.log((n + p * k) / max(n - p * k, 1e-9))}[criterion]
        best = min(best, (value, p))
    return best[1]


def var_lingam(x: np.ndarray, lags: int = 1, criterion: str | None = None, known: np.ndarray | None = None, ridge: float = 1.0, prune: bool = False, allowed: np.ndarray | None = None) -> tuple:
    """(B0, B1, ..., order): ridge VAR, DirectLiNGAM on its residuals, lagged effects through I - B0.

    With a ``criterion`` the order is searched up to ``lags``.  ``prune`` refits
    each variable on its predecessors at t and all lags by the adaptive lasso.
    ``allowed[i, j]`` masks the lagged i that the equation of j sees, and the
    effects of i on j altogether.
    """
    x = x - x.mean(0)
    d = x.shape[1]
    p = var_order(x, lags, criterion) if criterion else lags
    now, past = lagged_blocks(x, p)
    m = np.zeros((p * d, d))
    for j in range(d):
        use = np.arange(p * d) if allowed is None else np.flatnonzero(np.tile(allowed[:, j], p))
        m[use, j] = np.linalg.solve(past[:, use].T @ past[:, use] + ridge * np.eye(len(use)), past[:, use].T @ now[:, j])
    b0, order = direct_lingam(now - past @ m, known)
    out = [b0, *(m[k * d : (k + 1) * d] @ (np.eye(d) - b0) for k in range(p))]
    if prune:
        for k, j in enumerate(order):
            before = [i for i in order[:k] if known is None or known[i, j] != 0]
            use = np.arange(p * d) if allowed is None else np.flatnonzero(np.tile(allowed[:, j], p))
            b = adaptive_lasso(np.hstack([now[:, before], past[:, use]]), now[:, j])
            out[0][:, j] = 0
            out[0][before, j] = b[: len(before)]
            column = np.zeros(p * d)
            column[use] = b[len(before) :]
            for lag in range(p):
                out[lag + 1][:, j] = column[lag * d : (lag + 1) * d]
    if allowed is not None:
        out = [np.where(allowed, b, 0) for b in out]
    return (*out, order)


def threshold_till_acyclic(w: np.ndarray) -> np.ndarray:
    """Zero the weakest edge of all until there is no cycle."""
    w = w.copy()
    while find_cycle(w != 0) is not None:
        w[np.abs(w) == np.abs(w[w != 0]).min()] = 0
    return w


def linkage_order(dist: np.ndarray, method: str = "single") -> list[int]:
    """Leaf order of a ``single``, ``average``, ``complete`` or ``ward`` clustering (Lance and Williams); ties go to the smaller pair."""
    n = len(dist)
    d = {(i, j): float(dist[i, j]) ** (2 if method == "ward" else 1) for i in range(n) for j in range(i + 1, n)}
    leaves, size, fresh = {i: [i] for i in range(n)}, dict.fromkeys(range(n), 1), n
    while len(leaves) > 1:
        a, b = min(d, key=lambda p: (d[p], p))
        near = d.pop((a, b))
        na, nb = size.pop(a), size.pop(b)
        for k in [k for k in leaves if k not in (a, b)]:
            x, y, nk = d.pop((min(a, k), max(a, k))), d.pop((min(b, k), max(b, k))), size[k]
            d[k, fresh] = {"single": min(x, y), "complete": max(x, y), "average": (na * x + nb * y) / (na + nb), "ward": ((na + nk) * x + (nb + nk) * y - nk * near) / (na + nb + nk)}[method]
        leaves[fresh], size[fresh] = leaves.pop(a) + leaves.pop(b), na + nb
        fresh += 1
    return next(iter(leaves.values()))


def hierarchical_weights(cov: np.ndarray, dist: np.ndarray, method: str = "single") -> np.ndarray:
    """Recursive bisection of the leaf order, each half weighed by the other's inverse-variance cluster variance."""
    w = np.ones(len(cov))
    stack = [linkage_order(dist, method)]
    while stack:
        items = stack.pop()
        if len(items) < 2:
            continue
        halves = items[: len(items) // 2], items[len(items) // 2 :]
        var = []
        for h in halves:
            c = cov[np.ix_(h, h)]
            iv = 1 / np.maximum(np.diag(c), 1e-12)
            iv /= iv.sum()
            var.append(float(iv @ c @ iv))
        share = 1 - var[0] / max(var[0] + var[1], 1e-300)
        w[halves[0]] *= share
        w[halves[1]] *= 1 - share
        stack += halves
    return w / w.sum()


def nearest_psd(m: np.ndarray, floor: float = 1e-10) -> np.ndarray:
    """Symmetric part with eigenvalues raised to ``floor``."""
    value, vector = np.linalg.eigh((m + m.T) / 2)
    return (vector * np.maximum(value, floor)) @ vector.T


def causal_distance(effects: np.ndarray) -> np.ndarray:
    """Euclidean distance between variables embedded by their outgoing and incoming effects."""
    z = np.hstack([effects, effects.T])
    return np.sqrt(np.maximum(((z[:, None] - z[None, :]) ** 2).sum(-1), 0))


def structural_covariance(effects: np.ndarray, cov: np.ndarray) -> np.ndarray:
    """(I - M')^-1 S (I - M')^-T of errors with covariance S; effects[i, j] is i on j."""
    a = np.linalg.pinv(np.eye(len(effects)) - effects.T)
    return a @ cov @ a.T


def effective_dimension(s: np.ndarray, share: float = 0.95) -> int:
    """Principal components that hold ``share`` of the variance of the columns' profiles; 0 without any."""
    x = s.T - s.T.mean(0)
    v = np.linalg.svd(x, compute_uv=False) ** 2
    return 0 if v.sum() <= 0 else int(np.searchsorted(np.cumsum(v) / v.sum(), share - 1e-12) + 1)


def knee(scores: np.ndarray) -> int:
    """Place (from 1) of the falling curve's farthest point from its chord; 1 for a flat curve."""
    y = np.sort(scores)[::-1]
    if len(y) < 2 or y[0] - y[-1] <= 0:
        return 1
    return int(np.argmax(np.round(np.abs(np.linspace(0, 1, len(y)) + (y - y[-1]) / (y[0] - y[-1]) - 1), 12))) + 1


def calibrate_k(real: np.ndarray, null: np.ndarray, quantile: float = 0.95) -> tuple[int, int, int, list[int]]:
    """(K of the knee, K above the null, K, sweep): the null's threshold is a quantile of each replicate's largest score."""
    pool = len(real)
    by_knee = knee(real)
    by_null = int((real > np.quantile(null.max(1), quantile)).sum()) if len(null) else 0
    k = int(np.clip(max(by_knee, by_null), 1, max(pool, 1)))
    ends = [max(1, -(-k // 2)), k, max(1, min(2 * k, pool // 2))]
    return by_knee, by_null, k, sorted({*ends, (ends[0] + ends[1]) // 2, (ends[1] + ends[2]) // 2})


def onto_simplex(v: np.ndarray) -> np.ndarray:
    u = np.sort(v)[::-1]
    c = np.cumsum(u) - 1
    k = np.flatnonzero(u - c / np.arange(1, len(v) + 1) > 0)[-1]
    return np.maximum(v - c[k] / (k + 1), 0)


def onto_capped_simplex(v: np.ndarray, cap: float) -> np.ndarray:
    """The nearest point with parts in [0, cap] that sum to 1, by bisection on the shift; a cap below 1/n is 1/n."""
    cap = max(cap, 1 / len(v))
    lo, hi = v.min() - 1, v.max()
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if np.clip(v - mid, 0, cap).sum() > 1 else (lo, mid)
    return np.clip(v - (lo + hi) / 2, 0, cap)


def simplex_weights(cov: np.ndarray, mean: np.ndarray | None = None, gamma: float = 1.0, cap: float | None = None) -> np.ndarray:
    """Long-only weights, none above ``cap``, minimising gamma w'Cw - mean'w: accelerated projected gradient."""
    mean = np.zeros(len(cov)) if mean is None else mean
    step = 1 / max(2 * gamma * np.linalg.norm(cov, 2), 1e-12)
    w = v = np.full(len(cov), 1 / len(cov))
    t = 1.0
    for _ in range(5000):
        moved = v - step * (2 * gamma * cov @ v - mean)
        new = onto_simplex(moved) if cap is None else onto_capped_simplex(moved, cap)
        t_new = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v = new + (t - 1) / t_new * (new - w)
        if np.abs(new - w).max() < 1e-12:
            w = new
            break
        w, t = new, t_new
    return w


def shrunk_covariance(x: np.ndarray) -> np.ndarray:
    """Ledoit-Wolf shrinkage towards a scaled identity."""
    x = x - x.mean(0)
    n, d = x.shape
    s = x.T @ x / n
    mu = np.trace(s) / d
    delta = ((s - mu * np.eye(d)) ** 2).sum()
    beta = min(delta, (((x**2).T @ (x**2)) / n - s**2).sum() / n)
    share = beta / delta if delta else 0.0
    return share * mu * np.eye(d) + (1 - share) * s


def greedy_drivers(x: np.ndarray, y: np.ndarray, k: int, ridge: float = 1.0) -> list[tuple[int, float]]:
    """Forward selection of columns by the fall of half the squared error on the last fifth."""
    cut = int(len(x) * 0.8)
    fit, test = slice(0, cut), slice(cut, None)

    def loss(columns):
        if not columns:
            return 0.5 * float(((y[test] - y[fit].mean(0)) ** 2).mean())
        a, m = x[fit][:, columns], x[fit][:, columns].mean(0)
        b = np.linalg.solve((a - m).T @ (a - m) + ridge * np.eye(len(columns)), (a - m).T @ (y[fit] - y[fit].mean(0)))
        return 0.5 * float(((y[test] - y[fit].mean(0) - (x[test][:, columns] - m) @ b) ** 2).mean())

    chosen, out, now = [], [], loss([])
    while len(chosen) < min(k, x.shape[1]):
        rest = [j for j in range(x.shape[1]) if j not in chosen]
        losses = [loss([*chosen, j]) for j in rest]
        best = int(np.argmin(losses))
        if now - losses[best] <= 0:
            break
        out.append((rest[best], now - losses[best]))
        chosen.append(rest[best])
        now = losses[best]
    return out


def _adf(x: np.ndarray, lags: int, first: int) -> tuple[float, float]:
    """(t statistic of the level, AIC) of a Dickey-Fuller regression with constant on the differences from ``first`` on."""
    dx = np.diff(x)
    y = dx[first:]
    z = np.column_stack([x[first:-1], *(dx[first - k : len(dx) - k] for k in range(1, lags + 1)), np.ones(len(y))])
    b, *_ = np.linalg.lstsq(z, y, rcond=None)
    e = y - z @ b
    rss = float(e @ e)
    if rss <= 0 or len(y) <= z.shape[1]:
        return float("nan"), math.inf
    return float(b[0] / math.sqrt(rss / (len(y) - z.shape[1]) * np.linalg.pinv(z.T @ z)[0, 0])), len(y) * math.log(rss / len(y)) + 2 * z.shape[1]


def adf_test(x: np.ndarray, most: int | None = None) -> tuple[float, float, int]:
    """(statistic, p, lags) with the lags of least AIC; nan below 20 rows and for a constant.

    The p-value is MacKinnon's (1994) response surface for a regression with constant.
    """
    nothing = float("nan"), float("nan"), 0
    x = x[np.isfinite(x)]
    if len(x) < 20 or np.ptp(x) == 0:
        return nothing
    most = min(math.ceil(12 * (len(x) / 100) ** 0.25), len(x) // 2 - 2) if most is None else most
    lags = min(range(most + 1), key=lambda k: (_adf(x, k, most)[1], k))
    t = _adf(x, lags, lags)[0]
    # MacKinnon's coefficients, and where they hold.
    low, high, joint = -18.83, 2.74, -1.61
    small, large = (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)
    if not math.isfinite(t):
        return nothing
    if t > high or t < low:
        return t, float(t > high), lags
    z = sum(c * t**k for k, c in enumerate(small if t <= joint else large))
    return t, 0.5 * math.erfc(-z / math.sqrt(2)), lags


def kpss_test(x: np.ndarray) -> tuple[float, float, int]:
    """(statistic, p, lags) of level stationarity, lags by Hobijn's rule; p from the published table, so within [0.01, 0.1]."""
    x = x[np.isfinite(x)]
    n = len(x)
    if n < 20 or np.ptp(x) == 0:
        return float("nan"), float("nan"), 0
    e = x - x.mean()
    s0, s1 = float(e @ e) / n, 0.0
    for k in range(1, int(n ** (2 / 9)) + 1):
        c = 2 * float(e[k:] @ e[:-k]) / n
        s0, s1 = s0 + c, s1 + k * c
    lags = min(int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)), n - 1)
    long_run = float(e @ e) / n + 2 * sum((1 - k / (lags + 1)) * float(e[k:] @ e[:-k]) / n for k in range(1, lags + 1))
    stat = float((np.cumsum(e) ** 2).sum() / (n * n * long_run)) if long_run > 0 else float("nan")
    # Critical values of the statistic at these levels.
    return stat, float(np.interp(stat, (0.347, 0.463, 0.574, 0.739), (0.10, 0.05, 0.025, 0.01))), lags


def _gram(x: np.ndarray) -> np.ndarray:
    d = (x[:, None] - x[None, :]) ** 2
    pos = d[d > 0]
    return np.exp(-d / (np.median(pos) if len(pos) else 1.0))


def hsic(x: np.ndarray, y: np.ndarray) -> float:
    """Biased HSIC statistic with median-distance Gaussian kernels."""
    n = len(x)
    centre = np.eye(n) - 1 / n
    return float(np.trace(centre @ _gram(x) @ centre @ _gram(y)) / n)
