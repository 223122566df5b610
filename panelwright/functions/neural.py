"""Small networks in numpy: driver sensitivities of a shared perceptron, and nonlinear acyclic graphs."""

from __future__ import annotations

import math

import numpy as np

from .kernels import break_cycles

#: Rows a sensitivity fit needs once its inputs are lagged.
MIN_ROWS = 50
_GELU = math.sqrt(2 / math.pi)


def _gelu(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Value and slope of the tanh form."""
    t = np.tanh(_GELU * (x + 0.044715 * x**3))
    return 0.5 * x * (1 + t), 0.5 * (1 + t) + 0.5 * x * (1 - t * t) * _GELU * (1 + 0.134145 * x * x)


class Adam:
    """Adam with decoupled weight decay over a list of arrays, which it changes in place."""

    def __init__(self, params: list[np.ndarray], rate: float, decay: float = 0.0):
        self.params, self.rate, self.decay, self.t = params, rate, decay, 0
        self.m, self.v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]

    def step(self, grads: list[np.ndarray]) -> None:
        self.t += 1
        for p, g, m, v in zip(self.params, grads, self.m, self.v, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p *= 1 - self.rate * self.decay
            p -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)


def sensitivities(drivers: np.ndarray, assets: np.ndarray, eligible: np.ndarray | None = None, lags: int = 1, depth: int = 1, width: int = 16, epochs: int = 200, patience: int = 20, seed: int = 0) -> np.ndarray:
    """S[driver, asset]: mean Jacobian over the training rows of a network from lagged drivers to assets, summed over lags.

    Losses skip cells that are not eligible; training stops when the error of the
    last fifth has not improved for ``patience`` epochs.  Needs 50 rows.
    """
    n = len(drivers) - lags
    if n < MIN_ROWS:
        raise ValueError(f"sensitivities need at least {MIN_ROWS} rows after lagging")
    x = np.hstack([drivers[lags - k : len(drivers) - k] for k in range(1, lags + 1)])
    y = assets[lags:]
    mask = np.ones_like(y) if eligible is None else eligible[lags:].astype(float)
    cut = int(n * 0.8)
    rng = np.random.default_rng(seed)
    sizes = [x.shape[1], *[width] * depth, y.shape[1]]
    params = []
    for a, b in zip(sizes, sizes[1:], strict=False):
        params += [rng.normal(size=(a, b)) / math.sqrt(a), np.zeros(b)]

    def forward(rows: np.ndarray) -> tuple[np.ndarray, list, list]:
        h, inputs, gates = rows, [], []
        for k in range(0, len(params), 2):
            inputs.append(h)
            h = h @ params[k] + params[k + 1]
            if k < len(params) - 2:
                h, gate = _gelu(h)
                gates.append(gate)
        return h, inputs, gates

    optimiser = Adam(params, 1e-2, 1e-4)
    best, kept, since = np.inf, [p.copy() for p in params], 0
    for _ in range(epochs):
        out, inputs, gates = forward(x[:cut])
        g = 2 * (out - y[:cut]) * mask[:cut] / max(mask[:cut].sum(), 1)
        grads: list[np.ndarray] = []
        for k in range(len(params) - 2, -1, -2):
            grads = [inputs[k // 2].T @ g, g.sum(0), *grads]
            if k:
                g = (g @ params[k].T) * gates[k // 2 - 1]
        optimiser.step(grads)
        error = math.sqrt(float((((forward(x[cut:])[0] - y[cut:]) ** 2) * mask[cut:]).sum()) / max(mask[cut:].sum(), 1))
        if error < best - 1e-6:
            best, kept, since = error, [p.copy() for p in params], 0
        else:
            since += 1
            if since >= patience:
                break
    for p, q in zip(params, kept, strict=True):
        p[...] = q
    _, _, gates = forward(x[:cut])
    jac = np.broadcast_to(params[0], (cut, *params[0].shape))
    for k, gate in enumerate(gates):
        jac = (jac * gate[:, None, :]) @ params[2 * k + 2]
    return jac.mean(0).reshape(lags, drivers.shape[1], -1).sum(0)


def expand_types(x: np.ndarray, kinds: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(features, variable of each feature, kinds of the features): ``categorical:K`` becomes K indicator columns.

    Permitted: ``continuous``, ``binary`` (0, 1), ``count`` (whole, from 0), ``ordinal:K`` and ``categorical:K``
    (codes 0 to K - 1).  Raises ValueError where a column does not hold what its type permits.
    """
    features, owner, out = [], [], []
    for j, kind in enumerate(kinds):
        base, _, size = kind.partition(":")
        column = x[:, j]
        if base in ("ordinal", "categorical"):
            if not size.isdecimal() or int(size) < 2:
                raise ValueError(f"{kind!r} needs a number of levels from 2")
            top = int(size) - 1
        elif size or base not in ("continuous", "binary", "count"):
            raise ValueError(f"unknown column type {kind!r}")
        else:
            top = {"continuous": None, "binary": 1, "count": np.inf}[base]
        if top is not None and not ((column == np.floor(column)) & (column >= 0) & (column <= top)).all():
            raise ValueError(f"column {j} has values that {kind!r} does not permit")
        parts = [(column == k).astype(float) for k in range(top + 1)] if base == "categorical" else [column]
        features += parts
        owner += [j] * len(parts)
        out += [kind] * len(parts)
    return np.column_stack(features), np.array(owner), out


def _sigmoid(t: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(t, -30, 30)))


def _cuts(y: np.ndarray, levels: int) -> np.ndarray:
    """Thresholds of a cumulative logit model at the shares of the levels, open at both ends."""
    share = np.clip(np.array([(y <= k).mean() for k in range(levels - 1)]), 1e-6, 1 - 1e-6)
    return np.concatenate([[-np.inf], np.log(share / (1 - share)), [np.inf]])


def _residual(kind: str, eta: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Gradient of the mean loss by the linear predictors: one column of them, or the K of a categorical variable."""
    n = len(y)
    if kind == "continuous":
        return (eta - y) / n
    if kind == "binary":
        return (_sigmoid(eta) - y) / n
    if kind == "count":
        return (np.exp(np.clip(eta, -20, 20)) - y) / n
    if kind.startswith("ordinal"):
        cuts, level = _cuts(y, int(kind.partition(":")[2])), y.astype(int)[:, 0]
        return (1 - _sigmoid(cuts[level + 1][:, None] - eta) - _sigmoid(cuts[level][:, None] - eta)) / n
    p = np.exp(eta - eta.max(1, keepdims=True))
    return (p / p.sum(1, keepdims=True) - y) / n


def nonlinear_graph(x: np.ndarray, kinds: list[str] | None = None, lags: int = 0, forbidden: np.ndarray | None = None, hidden: int = 8, l1: float = 0.01, l2: float = 0.01, rounds: int = 10, inner: int = 300, threshold: float = 0.3, seed: int = 0) -> list[np.ndarray]:
    """Effects [lag 0, lag 1, ...], each M[i, j] the norm of i's weights in the network of j; lag 0 is acyclic.

    A hidden layer of sigmoids per column sees all other columns and the lagged
    rows; an augmented Lagrangian drives h = tr((I + W/d)^d) - d of the lag-0
    squared norms W to zero.  Column types are those of ``expand_types``; the norms
    of a categorical variable are over its indicators, which see each other only
    at lags.  Thresholds of ordinal columns stay at the shares of their levels.
    ``forbidden`` is (1 + lags, variables, variables).
    """
    variables = x.shape[1]
    x, owner, kinds = expand_types(x, kinds or ["continuous"] * variables)
    d = x.shape[1]
    member = np.eye(variables)[owner]
    blocks = [np.flatnonzero(owner == v) for v in range(variables)]
    scaled = (x - x.mean(0)) / np.maximum(x.std(0), 1e-12)
    z = np.hstack([scaled[lags - k : len(x) - k] for k in range(lags + 1)])
    y = np.column_stack([scaled[lags:, j] if kinds[j] == "continuous" else x[lags:, j] for j in range(d)])
    open_ = np.ones((1 + lags, d, d), bool) if forbidden is None else ~forbidden[:, owner][:, :, owner]
    open_[0] &= owner[:, None] != owner
    gate = open_.reshape(-1, d).T[:, :, None].astype(float)  # target, input, 1
    rng = np.random.default_rng(seed)
    w1 = rng.normal(scale=0.3, size=(d, d * (1 + lags), hidden)) * gate
    b1, w2, b2 = np.zeros((d, hidden)), rng.normal(scale=0.3, size=(d, hidden)), np.zeros(d)
    rho, alpha, h_old = 1.0, 0.0, np.inf
    for _ in range(rounds):
        optimiser = Adam([w1, b1, w2, b2], 0.02)
        for _ in range(inner):
            s = 1 / (1 + np.exp(-np.clip(np.einsum("ni,jim->njm", z, w1) + b1, -30, 30)))
            eta = np.einsum("njm,jm->nj", s, w2) + b2
            g = np.column_stack([_residual(kinds[b[0]], eta[:, b], y[:, b]) for b in blocks])
            pre = g[:, :, None] * w2 * s * (1 - s)
            base = np.eye(variables) + member.T @ (w1[:, :d] ** 2).sum(2).T @ member / variables
            power = np.linalg.matrix_power(base, variables - 1)
            h = float((power * base.T).sum()) - variables
            power = member @ power @ member.T
            gw1 = np.einsum("ni,njm->jim", z, pre) + l2 * w1
            norm = np.sqrt((w1**2).sum(2, keepdims=True) + 1e-12)
            gw1 += l1 * w1 / norm
            gw1[:, :d] += (alpha + rho * h) * 2 * w1[:, :d] * power[:, :, None]
            optimiser.step([gw1 * gate, pre.sum(0), np.einsum("njm,nj->jm", s, g) + l2 * w2, g.sum(0)])
        if h <= 1e-8:
            break
        alpha += rho * h
        if h > 0.25 * h_old:
            rho *= 10
        h_old = h
    squares = ((w1**2).sum(2) * gate[:, :, 0]).T.reshape(1 + lags, d, d)
    strength = np.sqrt(member.T @ squares @ member)
    strength = np.where(strength < threshold, 0, strength)
    return [break_cycles(strength[0]), *strength[1:]]
