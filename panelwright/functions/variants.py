"""LiNGAM variants: groups of variables, moving averages, missing values, mixed types, latent factors; fit indices.

M[i, j] is the effect of i on j.
"""

from __future__ import annotations

import math

import numpy as np

from . import dependence as dep
from .discovery import acyclic_order, multi_group_lingam, residual, slopes
from .kernels import adaptive_lasso, direct_lingam, lagged_blocks, pairwise_gain


def _laplace(e: np.ndarray) -> float:
    """Mean log-likelihood of Laplace errors at their own scale."""
    return -math.log(2 * max(float(np.abs(e).mean()), 1e-300)) - 1


def _leads(cause: np.ndarray, effect: np.ndarray) -> float:
    """By how much cause -> effect is likelier than the other way, with Laplace errors and least squares."""
    forward = _laplace(cause - cause.mean()) + _laplace(residual(cause[:, None], effect))
    return forward - _laplace(effect - effect.mean()) - _laplace(residual(effect[:, None], cause))


def group_direct_lingam(x: np.ndarray, groups: list[list[int]]) -> tuple[np.ndarray, list[int]]:
    """(effects, order of the groups): the group whose variables look least like effects of the others comes first.

    A variable of a later group is compared with each cause by the part of it that
    this cause and the residual on the whole cause group make up.
    """
    data, left, order = x - x.mean(0), list(range(len(groups))), []
    while left:
        against = {}
        for g in left:
            own, losses = data[:, groups[g]], []
            for i in (i for h in left if h != g for i in groups[h]):
                b = slopes(own, data[:, i])
                e = data[:, i] - own @ b
                losses += [min(0.0, _leads(own[:, k], own[:, k] * b[k] + e)) ** 2 for k in range(len(b))]
            against[g] = float(np.mean(losses)) if losses else 0.0
        first = min(left, key=lambda g: (against[g], g))
        order.append(first)
        left.remove(first)
        rest = [i for h in left for i in groups[h]]
        if rest:
            data[:, rest] = residual(data[:, groups[first]], data[:, rest])
    out = np.zeros((x.shape[1],) * 2)
    for k, g in enumerate(order):
        before = [i for h in order[:k] for i in groups[h]]
        for j in groups[g]:
            out[before, j] = adaptive_lasso(x[:, before], x[:, j])
    return out, order


def varma(x: np.ndarray, p: int = 1, q: int = 1, rounds: int = 10) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(autoregressive (p, d, d), moving-average (q, d, d), residuals) by repeated least squares.

    Residuals of a long autoregression stand for the shocks at first, those of the fit itself afterwards
    (Hannan and Rissanen).  The first rows, without all their lags, have no residuals.
    """
    x = x - x.mean(0)
    n, d = x.shape
    long = max(1, p, min(p + q + 4, n // (4 * d)))
    now, past = lagged_blocks(x, long)
    shocks = np.vstack([np.zeros((long, d)), now - past @ np.linalg.lstsq(past, now, rcond=None)[0]])
    start, m = long + q, np.zeros(((p + q) * d, d))
    for _ in range(rounds if q else 1):
        design = np.hstack([x[start - k : n - k] for k in range(1, p + 1)] + [shocks[start - k : n - k] for k in range(1, q + 1)])
        new = np.linalg.lstsq(design, x[start:], rcond=None)[0]
        shocks = shocks.copy()
        shocks[start:] = x[start:] - design @ new
        moved, m = np.abs(new - m).max(), new
        if moved < 1e-8:
            break
    return m[: p * d].reshape(p, d, d), m[p * d :].reshape(q, d, d), shocks[start:]


def varma_order(x: np.ndarray, most_p: int = 2, most_q: int = 1) -> tuple[int, int]:
    """(p, q) with the least BIC over the rows that every candidate has; ties go to the smaller."""
    best = (math.inf, 1, 0)
    for p in range(1, most_p + 1):
        for q in range(most_q + 1):
            e = varma(x, p, q)[2][-(len(x) - most_p - 2 * most_q - 4) :]
            _, logdet = np.linalg.slogdet(e.T @ e / len(e))
            best = min(best, (logdet + math.log(len(e)) / len(e) * (p + q) * x.shape[1] ** 2, p, q))
    return best[1], best[2]


def varma_lingam(x: np.ndarray, p: int = 1, q: int = 1, search: bool = False) -> tuple[list[np.ndarray], list[np.ndarray], list[int]]:
    """([B0, B1, ..., Bp], [O1, ..., Oq], order): DirectLiNGAM on the residuals of a VARMA.

    With x_t = x_(t-k) Phi_k + u_t + u_(t-k) Theta_k and u = e (I - B0)^-1, lagged effects are Phi_k (I - B0),
    those of past errors (I - B0)^-1 Theta_k (I - B0).
    """
    if search:
        p, q = varma_order(x, p, q)
    ar, ma, shocks = varma(x, p, q)
    b0, order = direct_lingam(shocks)
    now = np.eye(len(b0)) - b0
    return [b0, *(m @ now for m in ar)], [np.linalg.solve(now, m @ now) for m in ma], order


def glm(x: np.ndarray, y: np.ndarray, kind: str, ridge: float = 1e-3, rounds: int = 60) -> np.ndarray:
    """Intercept and slopes of a logistic (``binary``) or Poisson (``count``) model by damped Newton steps."""
    z = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(z.shape[1])
    floor = ridge * np.eye(len(b))
    if kind == "count":
        b[0] = math.log(max(float(y.mean()), 1e-6))
    for _ in range(rounds):
        eta = np.clip(z @ b, -30, 30)
        mean = 1 / (1 + np.exp(-eta)) if kind == "binary" else np.exp(np.minimum(eta, 20))
        curve = mean * (1 - mean) if kind == "binary" else mean
        step = np.linalg.solve((z * curve[:, None]).T @ z + floor, z.T @ (y - mean) - ridge * b)
        step *= min(1.0, 5 / max(float(np.abs(step).max()), 1e-300))
        b = b + step
        if np.abs(step).max() < 1e-9:
            break
    return b


def _log_likelihood(x: np.ndarray, y: np.ndarray, kind: str) -> float:
    """Of a column given its parents: Laplace errors, logistic or Poisson (up to the factorials)."""
    if kind == "continuous":
        return len(y) * _laplace(residual(x, y))
    b = glm(x, y, kind)
    eta = np.clip(b[0] + x @ b[1:], -30, 30)
    return float((y * eta - (np.logaddexp(0, eta) if kind == "binary" else np.exp(np.minimum(eta, 20)))).sum())


def mixed_lingam(x: np.ndarray, kinds: list[str], penalty: float = 0.5) -> np.ndarray:
    """Graph of continuous, binary and count columns: slopes of each column's model on its parents.

    Edges are added, dropped and turned while that raises the likelihood less ``penalty`` ln(n) an edge, from the
    empty graph and from DirectLiNGAM's, and the better end counts.  Continuous columns are standardised for the
    search, so scales decide nothing; slopes are in original units.
    """
    n, d = x.shape
    z = np.column_stack([(x[:, j] - x[:, j].mean()) / max(x[:, j].std(), 1e-12) if kinds[j] == "continuous" else x[:, j] for j in range(d)])
    known: dict[tuple[int, tuple[int, ...]], float] = {}

    def score(j: int, pa: np.ndarray) -> float:
        key = (j, tuple(np.flatnonzero(pa)))
        if key not in known:
            known[key] = _log_likelihood(z[:, key[1]], z[:, j], kinds[j]) - penalty * math.log(n) * len(key[1])
        return known[key]

    def total(g: np.ndarray) -> float:
        return sum(score(j, g[:, j]) for j in range(d))

    def moves(g: np.ndarray):
        for i, j in zip(*np.nonzero(~np.eye(d, dtype=bool)), strict=True):
            new = g.copy()
            new[i, j] = not g[i, j]
            yield new
            if g[i, j]:
                turned = new.copy()
                turned[j, i] = True
                yield turned

    def climb(g: np.ndarray) -> tuple[float, np.ndarray]:
        here = total(g)
        while True:
            best = max(((total(m), k, m) for k, m in enumerate(moves(g)) if acyclic_order(m) is not None), key=lambda t: (t[0], -t[1]))
            if best[0] <= here + 1e-9:
                return here, g
            here, _, g = best

    ends = [climb(np.zeros((d, d), bool)), climb(direct_lingam(z)[0] != 0)]
    g = max(ends, key=lambda e: e[0])[1]
    out = np.zeros((d, d))
    for j in range(d):
        pa = np.flatnonzero(g[:, j])
        if len(pa):
            out[pa, j] = slopes(x[:, pa], x[:, j]) if kinds[j] == "continuous" else glm(x[:, pa], x[:, j], kinds[j])[1:]
    return out


def _logistic_support(x: np.ndarray, y: np.ndarray, steps: int = 50, rounds: int = 300) -> list[int]:
    """Columns of an L1 logistic model at the penalty, of a falling row of them, whose refit has the least BIC."""
    n = len(y)
    z = (x - x.mean(0)) / np.maximum(x.std(0), 1e-12)
    top = float(np.abs(z.T @ (y - y.mean())).max()) / n
    rate = 4 / max(float(np.linalg.eigvalsh(z.T @ z / n)[-1]) + 1, 1e-12)  # the logistic curve bends by 1/4 at most
    b, b0 = np.zeros(x.shape[1]), math.log(y.mean() / (1 - y.mean()))
    best, seen = (math.inf, []), set()
    for penalty in top * np.logspace(0, -3, steps):
        for _ in range(rounds):
            e = (1 / (1 + np.exp(-np.clip(b0 + z @ b, -30, 30))) - y) / n
            step = b - rate * (z.T @ e)
            new = np.sign(step) * np.maximum(np.abs(step) - rate * penalty, 0)
            b0 -= rate * float(e.sum())
            moved, b = np.abs(new - b).max(), new
            if moved < 1e-7:
                break
        support = tuple(np.flatnonzero(b))
        if support not in seen:
            seen.add(support)
            bic = -2 * _log_likelihood(z[:, support], y, "binary") + math.log(n) * len(support)
            best = min(best, (bic, list(support)))
    return best[1]


def missing_lingam(x: np.ndarray) -> tuple[np.ndarray, list[int], dict[int, dict[int, float]]]:
    """(effects, order, causes of missingness: column -> {cause: slope, -1: intercept}) of rows with nan.

    Whether a column is missing is explained by the other columns (L1 logistic model, BIC).  The order is
    DirectLiNGAM's with every pair measured on the rows that have both.  Effects come from rows complete in the
    columns a regression involves, the causes of their missingness included, each row weighed by one over its
    probability of being seen.  A column with no value at all or always missing together with the rest has no
    modelled cause.
    """
    gone, d = np.isnan(x), x.shape[1]
    causes: dict[int, dict[int, float]] = {}
    for j in np.flatnonzero(gone.any(0)):
        others = [i for i in range(d) if i != j]
        if len(np.unique(gone[~gone[:, others].any(1), j])) < 2:  # fall back to columns without gaps
            others = [i for i in others if not gone[:, i].any()]
        seen = ~gone[:, others].any(1)
        hit = gone[seen, j].astype(float)
        support = [others[k] for k in _logistic_support(x[np.ix_(seen, others)], hit)] if others and 0 < hit.mean() < 1 else []
        seen = ~gone[:, support].any(1)
        b = glm(x[np.ix_(seen, support)], gone[seen, j].astype(float), "binary", ridge=1.0)
        causes[int(j)] = {-1: float(b[0])} | {i: float(v) for i, v in zip(support, b[1:], strict=True)}

    def rows_and_weights(columns: list[int]) -> tuple[np.ndarray, np.ndarray]:
        involved = set(columns)
        while (more := involved | {i for j in involved & causes.keys() for i in causes[j] if i >= 0}) != involved:
            involved = more
        rows = ~gone[:, sorted(involved)].any(1)
        weight = np.ones(int(rows.sum()))
        for j in set(columns) & causes.keys():
            eta = causes[j][-1] + sum(x[rows, i] * v for i, v in causes[j].items() if i >= 0)
            weight = weight * (1 + np.exp(np.clip(eta, -30, 30)))  # 1 / (1 - p)
        return rows, weight

    data, left, order = x.copy(), list(range(d)), []
    while len(left) > 1:
        score = {}
        for j in left:
            loss = 0.0
            for i in left:
                both = ~gone[:, [i, j]].any(1)
                if i != j and both.sum() > 2:
                    pair = data[np.ix_(both, [j, i])]
                    loss += min(0.0, pairwise_gain(pair - pair.mean(0))[0, 1]) ** 2
            score[j] = loss
        first = min(left, key=lambda j: (score[j], j))
        order.append(first)
        left.remove(first)
        for i in left:
            both = ~gone[:, [i, first]].any(1)
            if both.sum() > 2:
                data[both, i] = residual(data[np.ix_(both, [first])], data[both, i])
    order += left
    out = np.zeros((d, d))
    for k, j in enumerate(order):
        use = order[:k]
        while use:  # fewer columns involve more rows, so prune until nothing goes
            rows, weight = rows_and_weights([j, *use])
            if rows.sum() <= len(use) + 1:
                rows = ~gone[:, [j, *use]].any(1)
                weight = np.ones(int(rows.sum()))
            if rows.sum() <= len(use) + 1:
                use = []
                break
            root, mean = np.sqrt(weight)[:, None], lambda m, w=weight: (m * w[:, None]).sum(0) / w.sum()
            a, t = x[np.ix_(rows, use)], x[rows][:, [j]]
            a, t = (a - mean(a)) * root, ((t - mean(t)) * root)[:, 0]
            kept = [i for i, v in zip(use, adaptive_lasso(a, t), strict=True) if v != 0]
            if kept == use:
                out[use, j] = np.linalg.lstsq(a, t, rcond=None)[0]
                break
            use = kept
    return out, order, causes


def factor_scores(x: np.ndarray, clusters: list[list[int]], rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """(scores with one column a cluster, loadings by column): a single factor behind the columns of each cluster.

    Principal-axis loadings of standardised columns, the largest one positive; Bartlett scores.  A cluster of one
    column is its own score, one of two columns has equal loadings.
    """
    z = (x - x.mean(0)) / np.maximum(x.std(0), 1e-12)
    scores, loadings = np.empty((len(x), len(clusters))), np.zeros(x.shape[1])
    for c, members in enumerate(clusters):
        r = z[:, members].T @ z[:, members] / len(z)
        common = np.ones(len(members)) if len(members) == 1 else np.abs(r - np.eye(len(r))).max(1)
        for _ in range(rounds):
            reduced = r.copy()
            np.fill_diagonal(reduced, common)
            values, vectors = np.linalg.eigh(reduced)
            load = vectors[:, -1] * math.sqrt(max(values[-1], 1e-12))
            new = np.minimum(load**2, 0.995) if len(members) > 1 else common
            moved, common = np.abs(new - common).max(), new
            if moved < 1e-10:
                break
        load = load * np.sign(load[np.argmax(np.abs(load))])
        weight = load / np.maximum(1 - load**2, 0.005)
        loadings[members], scores[:, c] = load, z[:, members] @ weight / float(weight @ load)
    return scores, loadings


def latent_lingam(domains: list[np.ndarray], clusters: list[list[int]]) -> tuple[list[np.ndarray], list[int]]:
    """(effects between the clusters' factors per domain, their order, shared by all domains)."""
    return multi_group_lingam([factor_scores(x, clusters)[0] for x in domains])


def fit_indices(x: np.ndarray, b: np.ndarray) -> dict[str, float]:
    """Gaussian fit of the graph of ``b`` (independent errors, slopes refitted): chi-square, CFI, TLI, NFI, RMSEA, AIC, BIC.

    Free parameters are the edges and one variance a column; the baseline model has no edges.  A graph with nan
    (hidden causes) has correlated errors, which this fit does not have.
    """
    if np.isnan(b).any() or acyclic_order(b) is None:
        raise ValueError("an acyclic graph without hidden causes is needed")
    n, d = x.shape
    x = x - x.mean(0)
    _, full = np.linalg.slogdet(x.T @ x / n)

    def misfit(graph: np.ndarray) -> float:  # at the maximum, ln |S^| = sum of log residual variances and tr(S S^^-1) = d
        return n * (sum(math.log(max(float(residual(x[:, np.flatnonzero(graph[:, j])], x[:, j]).var()), 1e-300)) for j in range(d)) - full)

    edges = int((b != 0).sum())
    chi2, base = max(misfit(b), 0.0), max(misfit(np.zeros((d, d))), 0.0)
    free, free_base = d * (d - 1) // 2 - edges, d * (d - 1) // 2
    log_l = -0.5 * (chi2 + n * (full + d + d * math.log(2 * math.pi)))
    over, over_base = max(chi2 - free, 0.0), max(base - free_base, 0.0)
    worst, ratio = max(over, over_base), base / free_base if free_base else 0.0
    return {
        "chi2": chi2,
        "dof": float(free),
        "p": dep.chi2_sf(chi2, free) if free else 1.0,
        "cfi": 1 - over / worst if worst else 1.0,
        "tli": (ratio - chi2 / free) / (ratio - 1) if free and ratio != 1 else 1.0,
        "nfi": 1 - chi2 / base if base else 1.0,
        "rmsea": math.sqrt(over / (free * (n - 1))) if free else 0.0,
        "aic": 2 * (edges + d) - 2 * log_l,
        "bic": math.log(n) * (edges + d) - 2 * log_l,
    }
