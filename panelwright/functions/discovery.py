"""Causal discovery beyond DirectLiNGAM: ICA, several groups, panels in time, hidden causes, nonlinear effects.

M[i, j] is the effect of i on j; nan marks a pair that a hidden common cause may explain.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import combinations

import numpy as np

from . import dependence as dep
from .kernels import adaptive_lasso, direct_lingam, pairwise_gain, var_lingam


def slopes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.linalg.lstsq(x - x.mean(0), y - y.mean(0), rcond=None)[0]


def residual(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """What a regression of y on the columns x leaves; y centred if there are none."""
    y = y - y.mean(0)
    return y if x.shape[1] == 0 else y - (x - x.mean(0)) @ slopes(x, y)


def assign(cost: np.ndarray) -> np.ndarray:
    """Column of each row in the cheapest one-to-one assignment: shortest augmenting paths with potentials."""
    n = len(cost)
    row_of = np.full(n, -1)
    u, v = np.zeros(n), np.zeros(n)
    for root in range(n):
        reach, via = np.full(n, np.inf), np.full(n, -1)
        done, row, col, base = np.zeros(n, bool), root, -1, 0.0
        while True:
            open_ = ~done
            through = base + cost[row] - u[row] - v
            better = open_ & (through < reach - 1e-15)
            reach[better], via[better] = through[better], row
            col = int(np.argmin(np.where(open_, reach, np.inf)))
            base = reach[col]
            done[col] = True
            if row_of[col] < 0:
                break
            row = row_of[col]
        inner = done & (row_of >= 0)
        u[row_of[inner]] += base - reach[inner]
        v[inner] -= base - reach[inner]
        u[root] += base
        while True:  # flip the path back to the root
            row = via[col]
            before = np.flatnonzero(row_of == row)
            row_of[col] = row
            if row == root:
                break
            col = int(before[0])
    out = np.empty(n, int)
    out[row_of] = np.arange(n)
    return out


def fast_ica(x: np.ndarray, seed: int = 0, rounds: int = 500) -> np.ndarray:
    """Unmixing matrix (sources = x @ W.T): whitening, then the symmetric fixed point with tanh."""
    x = x - x.mean(0)
    values, vectors = np.linalg.eigh(x.T @ x / len(x))
    white = vectors / np.sqrt(np.maximum(values, 1e-12)) @ vectors.T
    z = x @ white
    w = np.linalg.qr(np.random.default_rng(seed).normal(size=(x.shape[1],) * 2))[0]
    for _ in range(rounds):
        g = np.tanh(z @ w.T)
        new = g.T @ z / len(z) - (1 - g * g).mean(0)[:, None] * w
        a, _, b = np.linalg.svd(new)
        new = a @ b
        moved = np.abs(np.abs((new * w).sum(1)) - 1).max()
        w = new
        if moved < 1e-8:
            break
    return w @ white


def acyclic_order(b: np.ndarray) -> list[int] | None:
    """Parents before children, smaller index first; None if there is a cycle."""
    left, order = list(range(len(b))), []
    while left:
        free = [j for j in left if not b[left, j].any()]
        if not free:
            return None
        order.append(free[0])
        left.remove(free[0])
    return order


def refit(x: np.ndarray, order: list[int]) -> np.ndarray:
    b = np.zeros((x.shape[1],) * 2)
    for k, j in enumerate(order):
        b[order[:k], j] = adaptive_lasso(x[:, order[:k]], x[:, j])
    return b


def ica_lingam(x: np.ndarray, seed: int = 0) -> tuple[np.ndarray, list[int]]:
    """Unmix, put large entries on the diagonal, drop the smallest effects until an order exists, refit by the lasso."""
    w = fast_ica(x, seed)
    place = assign((1 / np.maximum(np.abs(w), 1e-12)))
    rows = np.empty_like(w)
    rows[place] = w
    b = (np.eye(len(w)) - rows / np.diag(rows)[:, None]).T
    d = len(b)
    small = np.argsort(np.abs(b), axis=None)
    for k in range(d * (d + 1) // 2, d * d + 1):
        kept = b.copy()
        kept.flat[small[:k]] = 0
        if (order := acyclic_order(kept)) is not None:
            return refit(x, order), order
    raise AssertionError("an empty graph has an order")


def multi_group_lingam(groups: list[np.ndarray]) -> tuple[list[np.ndarray], list[int]]:
    """One causal order for all groups, each group's measure weighed by its rows; effects per group."""
    data = [g - g.mean(0) for g in groups]
    total = sum(len(g) for g in data)
    left, order = list(range(data[0].shape[1])), []
    while len(left) > 1:
        score = -sum(len(g) / total * (np.minimum(0, pairwise_gain(g[:, left])) ** 2).sum(1) for g in data)
        m = left[int(np.argmax(score))]
        order.append(m)
        left.remove(m)
        for i, g in enumerate(data):
            g = g.copy()
            g[:, left] = residual(g[:, [m]], g[:, left])
            data[i] = g
    order += left
    return [refit(g, order) for g in groups], order


def longitudinal_lingam(times: list[np.ndarray], lags: int = 1) -> list[tuple[int, int, np.ndarray]]:
    """(time, lag, effects) for each time that has all its lags; row k of every block is the same subject."""
    out = []
    for t in range(lags, len(times)):
        past = np.hstack([times[t - k] for k in range(1, lags + 1)])
        m = slopes(past, times[t])
        b = direct_lingam(residual(past, times[t]))[0]
        d = len(b)
        out += [(t, 0, b), *((t, k + 1, m[k * d : (k + 1) * d] @ (np.eye(d) - b)) for k in range(lags))]
    return out


def bottom_up_parce(x: np.ndarray, alpha: float = 0.1, by_f_correlation: float | None = None) -> np.ndarray:
    """Sinks first: a sink's residual on the rest is independent of it.  Where none is, the rest is one unordered block."""
    left, sinks = list(range(x.shape[1])), []
    while len(left) > 1:
        best = None
        for j in left:
            rest = [i for i in left if i != j]
            e = residual(x[:, rest], x[:, j])
            if by_f_correlation is None:
                stat, p = dep.fisher_p([dep.hsic_test(e, x[:, i])[1] for i in rest])
                found = (stat, j, p >= alpha)
            else:
                stat = dep.f_correlation_of_any(e, x[:, rest])
                found = (stat, j, stat < by_f_correlation)
            best = found if best is None or found < best else best
        if not best[2]:
            break
        sinks.append(best[1])
        left.remove(best[1])
    order = left + sinks[::-1]
    b = np.zeros((x.shape[1],) * 2)
    for k in range(len(left), len(order)):
        b[order[:k], order[k]] = adaptive_lasso(x[:, order[:k]], x[:, order[k]])
    if len(left) > 1:
        b[np.ix_(left, left)] = np.nan
        np.fill_diagonal(b, 0)
    return b


def joint_p(test: Callable[..., float], *columns: list[np.ndarray]) -> float:
    """Fisher's combination over groups of a test's p; ``columns`` hold one array a group."""
    return dep.fisher_p([test(*group) for group in zip(*columns, strict=True)])[1]


def _hsic_p(a: np.ndarray, b: np.ndarray) -> float:
    return dep.hsic_test(a, b)[1]


def multi_group_rcd(groups: list[np.ndarray], max_others: int = 2, alpha: float = 0.01) -> list[np.ndarray]:
    """Repetitive causal discovery with one structure for all groups, every test combined over them; effects per group.

    Ancestors come from regression and independence, then parents; correlated
    leftovers are nan.  A residual must be non-normal (Shapiro-Francia) and
    correlated with the other residuals of its set to be judged.
    """
    d = groups[0].shape[1]
    anc: list[set[int]] = [set() for _ in range(d)]

    def left_of(j: int, given: set[int]) -> list[np.ndarray]:
        return [residual(x[:, sorted(given)], x[:, j]) for x in groups]

    def may_be_judged(y: dict[int, list[np.ndarray]]) -> bool:
        if any(joint_p(dep.normality_p, v) > alpha for v in y.values()):
            return False
        return all(joint_p(dep.correlation_p, y[i], y[j]) <= alpha for i, j in combinations(y, 2))

    def is_sink(i: int, y: dict[int, list[np.ndarray]]) -> bool:
        rest = [j for j in y if j != i]
        if any(i in anc[j] for j in rest):
            return False
        e = [residual(np.column_stack([y[j][g] for j in rest]), y[i][g]) for g in range(len(groups))]
        return all(joint_p(_hsic_p, e, y[j]) > alpha for j in rest)

    size = 2
    while size <= max_others + 1:
        changed = False
        for some in combinations(range(d), size):
            if any(set(some) - {i} <= anc[i] for i in some):
                continue
            common = set.intersection(*(anc[i] for i in some))
            y = {i: left_of(i, common) for i in some}
            sinks = [i for i in some if is_sink(i, y)] if may_be_judged(y) else []
            if len(sinks) == 1:
                new = (set(some) - {sinks[0]}) - anc[sinks[0]]
                anc[sinks[0]] |= new
                changed |= bool(new)
        size = 2 if changed else size + 1
    parents = [[i for i in sorted(anc[j]) if joint_p(dep.correlation_p, left_of(j, anc[j] - {i}), left_of(i, anc[i] & anc[j])) <= alpha] for j in range(d)]
    out = [np.zeros((d, d)) for _ in groups]
    for b, x in zip(out, groups, strict=True):
        for j, pa in enumerate(parents):
            if pa:
                b[pa, j] = slopes(x[:, pa], x[:, j])
    for i, j in combinations(range(d), 2):
        if j not in anc[i] and i not in anc[j] and joint_p(dep.correlation_p, left_of(i, set(parents[i])), left_of(j, set(parents[j]))) <= alpha:
            for b in out:
                b[i, j] = b[j, i] = np.nan
    return out


def rcd(x: np.ndarray, max_others: int = 2, alpha: float = 0.01) -> np.ndarray:
    return multi_group_rcd([x], max_others, alpha)[0]


def kernel_ridge(x: np.ndarray, y: np.ndarray, penalty: float = 0.1) -> np.ndarray:
    """In-sample fit of a Gaussian-kernel ridge regression with median bandwidth."""
    z = (x - x.mean(0)) / np.maximum(x.std(0), 1e-12)
    d = ((z[:, None] - z[None, :]) ** 2).sum(-1)
    width = np.median(d[d > 0]) if (d > 0).any() else 1.0
    k = np.exp(-d / width)
    return y.mean() + k @ np.linalg.solve(k + penalty * np.eye(len(k)), y - y.mean())


def spline_fit(x: np.ndarray, y: np.ndarray, knots: int = 5, penalty: float = 1e-6) -> np.ndarray:
    """In-sample fit of an additive model: cubic truncated powers of each column, ridge."""
    z = (x - x.mean(0)) / np.maximum(x.std(0), 1e-12)
    basis = [z, z**2, z**3]
    for q in np.linspace(0, 1, knots + 2)[1:-1]:
        basis.append(np.maximum(z - np.quantile(z, q, axis=0), 0) ** 3)
    h = np.hstack(basis)
    h = (h - h.mean(0)) / np.maximum(h.std(0), 1e-12)
    return y.mean() + h @ np.linalg.solve(h.T @ h / len(h) + penalty * np.eye(h.shape[1]), h.T @ (y - y.mean()) / len(h))


Regressor = Callable[[np.ndarray, np.ndarray], np.ndarray]


def multi_group_resit(groups: list[np.ndarray], regress: Regressor = kernel_ridge, alpha: float = 0.01) -> list[np.ndarray]:
    """0/1 parents per group under one order: sinks by the least dependent residuals over all groups (HSIC, Fisher's
    combination; the plain statistic for a single group), then parents that a group's residual does not need go."""
    d = groups[0].shape[1]
    left, parents = list(range(d)), {}
    while len(left) > 1:
        stats = []
        for j in left:
            rest = [i for i in left if i != j]
            tests = [dep.hsic_test(x[:, j] - regress(x[:, rest], x[:, j]), x[:, rest]) for x in groups]
            stats.append((tests[0][0] if len(groups) == 1 else dep.fisher_p([p for _, p in tests])[0], j))
        sink = min(stats)[1]
        left.remove(sink)
        parents[sink] = list(left)
    out = []
    for x in groups:
        b = np.zeros((d, d))
        for j, every in parents.items():
            pa = list(every)
            for i in every:
                rest = [k for k in pa if k != i]
                e = x[:, j] - (regress(x[:, rest], x[:, j]) if rest else x[:, j].mean())
                if dep.hsic_test(e, x[:, pa])[1] > alpha:
                    pa.remove(i)
            b[pa, j] = 1
        out.append(b)
    return out


def resit(x: np.ndarray, regress: Regressor = kernel_ridge, alpha: float = 0.01) -> np.ndarray:
    return multi_group_resit([x], regress, alpha)[0]


def multi_group_camuv(groups: list[np.ndarray], max_parents: int = 2, alpha: float = 0.01) -> np.ndarray:
    """0/1 parents, the same for all groups, under additive models with unobserved variables; tests are combined.

    Dependent residuals of unlinked neighbours are nan.
    """
    d = groups[0].shape[1]
    columns = [[x[:, j] for x in groups] for j in range(d)]
    near = [{j for j in range(d) if j != i and joint_p(_hsic_p, columns[i], columns[j]) <= alpha} for i in range(d)]
    pa: list[set[int]] = [set() for _ in range(d)]

    def left_of(j: int, given: set[int]) -> list[np.ndarray]:
        return [x[:, j] - (spline_fit(x[:, sorted(given)], x[:, j]) if given else x[:, j].mean()) for x in groups]

    size = 2
    while size <= max_parents + 1:
        changed = False
        for some in combinations(range(d), size):
            if any(j not in near[i] for i, j in combinations(some, 2)) or any(j in pa[i] or i in pa[j] for i, j in combinations(some, 2)):
                continue
            own = {i: left_of(i, pa[i]) for i in some}
            tried = []
            for child in some:
                others = set(some) - {child}
                e = left_of(child, pa[child] | others)
                tried.append((min(joint_p(_hsic_p, e, own[i]) for i in others), child))
            p, child = max(tried)
            others = set(some) - {child}
            if p > alpha and all(joint_p(_hsic_p, own[child], own[i]) <= alpha for i in others):
                pa[child] |= others
                changed = True
        size = 2 if changed else size + 1
    for j in range(d):
        for i in sorted(pa[j]):
            if joint_p(_hsic_p, left_of(j, pa[j] - {i}), left_of(i, pa[i])) > alpha:
                pa[j].discard(i)
    b = np.zeros((d, d))
    for j in range(d):
        b[sorted(pa[j]), j] = 1
    for i, j in combinations(range(d), 2):
        if j in near[i] and not b[i, j] and not b[j, i] and joint_p(_hsic_p, left_of(i, pa[i]), left_of(j, pa[j])) <= alpha:
            b[i, j] = b[j, i] = np.nan
    return b


def camuv(x: np.ndarray, max_parents: int = 2, alpha: float = 0.01) -> np.ndarray:
    return multi_group_camuv([x], max_parents, alpha)


def high_dim_lingam(x: np.ndarray, power: int = 4, alpha: float = 0.5) -> tuple[np.ndarray, list[int]]:
    """Order by moments: a root makes |E[p^(k-1) c] E[p^2] - E[p^k] E[p c]| vanish for all c, given those before it."""

    def tau(p: np.ndarray, c: np.ndarray) -> float:
        return abs(float((p ** (power - 1) * c).mean() * (p * p).mean() - (p**power).mean() * (p * c).mean()))

    z = (x - x.mean(0)) / np.maximum(x.std(0), 1e-12)
    left, order, cut = list(range(x.shape[1])), [], 0.0
    while left:
        e = {}
        for j in left:
            e[j] = residual(z[:, [i for i in order if abs(dep.correlation_p(z[:, i], z[:, j])) < max(cut, 0.05)]], z[:, j])
        worst = {i: max((tau(e[i], e[j]) for j in left if j != i), default=0.0) for i in left}
        root = min(left, key=lambda i: (worst[i], i))
        cut = min(0.5, max(cut, worst[root] * alpha))
        order.append(root)
        left.remove(root)
    return refit(x, order), order


def group_lingam(x: np.ndarray, alpha: float = 0.01) -> list[list[int]]:
    """Ordered groups: split where the residual of the rest on a subset is most independent of the subset."""

    def split(members: list[int]) -> list[list[int]]:
        best = (-1.0, None)
        for size in range(1, len(members)):
            for s in combinations(members, size):
                rest = [i for i in members if i not in s]
                e = residual(x[:, list(s)], x[:, rest])
                _, p = dep.fisher_p([dep.hsic_test(x[:, i], e[:, k])[1] for i in s for k in range(len(rest))])
                if p > best[0]:
                    best = (p, (list(s), rest))
        if best[1] is None or best[0] <= alpha:
            return [members]
        return split(best[1][0]) + split(best[1][1])

    return split(list(range(x.shape[1])))


def total_effects(b: np.ndarray) -> np.ndarray:
    """Sum over all directed paths of the product of their effects."""
    return np.linalg.inv(np.eye(len(b)) - b) - np.eye(len(b))


def error_independence(x: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pairwise HSIC p-values of the structural errors x - xB."""
    e = x - x @ np.nan_to_num(b)
    d = e.shape[1]
    p = np.ones((d, d))
    for i, j in combinations(range(d), 2):
        p[i, j] = p[j, i] = dep.hsic_test(e[:, i], e[:, j])[1]
    return p


def intervention_pairs(x: np.ndarray, b: np.ndarray, target: int) -> list[tuple[int, float, float]]:
    """(cause, E[target | do(mean + sd)], E[target | do(mean - sd)]) by propagating means in causal order."""
    mean, sd, t = x.mean(0), x.std(0), total_effects(b)[:, target]
    return [(i, float(mean[target] + sd[i] * t[i]), float(mean[target] - sd[i] * t[i])) for i in range(len(b)) if i != target]


def best_intervention(x: np.ndarray, b: np.ndarray, cause: int, target: int, wanted: float) -> float:
    """Value of the cause at which the target's mean is the wanted one; nan without an effect."""
    t = float(total_effects(b)[cause, target])
    return float(x[:, cause].mean() + (wanted - x[:, target].mean()) / t) if abs(t) > 1e-12 else float("nan")


def select_lags(x: np.ndarray, most: int = 5) -> int:
    """Order of a vector autoregression with the least BIC; ties go to the smaller."""
    x = x - x.mean(0)
    best = (math.inf, 1)
    for p in range(1, most + 1):
        now, past = x[most:], np.hstack([x[most - k : len(x) - k] for k in range(1, p + 1)])
        e = now - past @ np.linalg.lstsq(past, now, rcond=None)[0]
        _, logdet = np.linalg.slogdet(e.T @ e / len(e))
        best = min(best, (logdet + math.log(len(e)) / len(e) * p * x.shape[1] ** 2, p))
    return best[1]


def masked_var(x: np.ndarray, allowed: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """VAR(1) by ridge, the equation of j seeing only the lagged i with allowed[i, j]."""
    x = x - x.mean(0)
    past, now = x[:-1], x[1:]
    m = np.zeros(allowed.shape)
    for j in range(len(m)):
        use = np.flatnonzero(allowed[:, j])
        m[use, j] = np.linalg.solve(past[:, use].T @ past[:, use] + ridge * np.eye(len(use)), past[:, use].T @ now[:, j])
    return m


def bootstrap_var_lingam(x: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(B0, B1) of one series regrown from resampled residuals."""
    x = x - x.mean(0)
    past, now = x[:-1], x[1:]
    m = np.linalg.solve(past.T @ past + np.eye(x.shape[1]), past.T @ now)
    e = now - past @ m
    pick = np.random.default_rng(seed).integers(0, len(e), len(x))
    grown = np.zeros_like(x)
    grown[0] = x[0]
    for t in range(1, len(x)):
        grown[t] = grown[t - 1] @ m + e[pick[t]]
    return var_lingam(grown)[:2]
