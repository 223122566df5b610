"""Discrete factors: products, elimination, interventions and EM over arrays whose size depends on states, not rows."""

from __future__ import annotations

from dataclasses import dataclass, replace
from itertools import combinations

import numpy as np

#: Cells a factor may have; larger networks are refused, not approximated.
MAX_CELLS = 4_000_000


@dataclass(frozen=True)
class Factor:
    names: tuple[str, ...]
    table: np.ndarray


@dataclass(frozen=True)
class BayesNet:
    """``cpds[x]`` is P(x | parents) with the parents' axes first, then x; ``states[x]`` names the axis positions."""

    states: dict[str, list]
    cpds: dict[str, Factor]


def multiply(factors: list[Factor]) -> Factor:
    names = tuple(sorted({n for f in factors for n in f.names}))
    size = {n: s for f in factors for n, s in zip(f.names, f.table.shape, strict=True)}
    if np.prod([float(size[n]) for n in names]) > MAX_CELLS:
        raise ValueError(f"a factor over {names} is too large")
    out = np.ones([size[n] for n in names])
    for f in factors:
        axes = sorted(range(len(f.names)), key=lambda i: f.names[i])
        have = {f.names[i] for i in axes}
        out = out * f.table.transpose(axes).reshape([size[n] if n in have else 1 for n in names])
    return Factor(names, out)


def sum_out(f: Factor, name: str) -> Factor:
    i = f.names.index(name)
    return Factor(f.names[:i] + f.names[i + 1 :], f.table.sum(i))


def observe(f: Factor, evidence: dict[str, int]) -> Factor:
    index = tuple(evidence.get(n, slice(None)) for n in f.names)
    return Factor(tuple(n for n in f.names if n not in evidence), np.asarray(f.table[index]))


def elimination_order(factors: list[Factor], keep: set[str]) -> list[str]:
    """Next goes the name whose removal joins the fewest unlinked neighbours; ties by name."""
    near: dict[str, set[str]] = {}
    for f in factors:
        for n in f.names:
            near.setdefault(n, set()).update(set(f.names) - {n})
    order = []
    while rest := sorted(set(near) - keep):
        fill = {n: sum(b not in near[a] for a, b in combinations(sorted(near[n]), 2)) for n in rest}
        n = min(rest, key=lambda m: (fill[m], m))
        for a in near[n]:
            near[a] |= near[n] - {a}
            near[a].discard(n)
        del near[n]
        order.append(n)
    return order


def query(net: BayesNet, names: list[str], evidence: dict | None = None) -> Factor:
    """P(names | evidence) by variable elimination; raises if the evidence is impossible or a state unknown."""
    evidence = evidence or {}
    for n, v in evidence.items():
        if v not in net.states[n]:
            raise ValueError(f"{v!r} is no state of {n}")
    at = {n: net.states[n].index(v) for n, v in evidence.items()}
    factors = [observe(f, at) for f in net.cpds.values()]
    wanted = set(names) - set(evidence)
    for n in elimination_order(factors, wanted):
        hit = [f for f in factors if n in f.names]
        factors = [f for f in factors if n not in f.names] + [sum_out(multiply(hit), n)]
    out = multiply(factors)
    total = out.table.sum()
    if total <= 0:
        raise ValueError("the evidence has probability 0")
    return Factor(out.names, out.table / total)


def marginals(net: BayesNet, evidence: dict | None = None) -> dict[str, np.ndarray]:
    evidence = evidence or {}
    return {n: np.array([float(s == evidence[n]) for s in net.states[n]]) if n in evidence else query(net, [n], evidence).table for n in net.states}


def intervene(net: BayesNet, node: str, distribution: dict) -> BayesNet:
    """do(node ~ distribution): the node loses its parents; what is upstream keeps its own distribution."""
    p = np.array([float(distribution.get(s, 0.0)) for s in net.states[node]])
    if set(distribution) - set(net.states[node]) or (p < 0).any() or abs(p.sum() - 1) > 1e-9:
        raise ValueError(f"not a distribution over the states of {node}")
    return replace(net, cpds=net.cpds | {node: Factor((node,), p)})


def normalise(counts: np.ndarray, prior: float = 0.0) -> np.ndarray:
    """Counts to P(last axis | others); an unseen parent state is uniform."""
    c = counts + prior
    total = c.sum(-1, keepdims=True)
    return np.where(total > 0, c / np.where(total > 0, total, 1), 1 / c.shape[-1])


def fit_latent(net: BayesNet, latent: str, rows: np.ndarray, names: list[str], counts: np.ndarray, rounds: int = 200, tolerance: float = 1e-6, prior: float = 0.0, bounds: dict[str, tuple[np.ndarray, np.ndarray]] | None = None) -> tuple[BayesNet, list[float]]:
    """EM for one unobserved node: (network, log-likelihood of each round).

    ``rows`` are the distinct state positions of ``names`` (the latent's Markov
    blanket) and ``counts`` how often each occurs.  ``bounds`` clips entries of
    CPDs to [low, high] before they are normalised again.
    """
    cpds = dict(net.cpds)
    touched = [n for n, f in cpds.items() if latent in f.names]
    at = {n: rows[:, i] for i, n in enumerate(names)}
    k = len(net.states[latent])
    history: list[float] = []
    for _ in range(rounds):
        joint = np.ones((len(rows), k))
        cells = {}
        for n in touched:
            f = cpds[n]
            index = tuple(np.arange(k)[None, :] if m == latent else at[m][:, None] for m in f.names)
            cells[n] = np.broadcast_arrays(*index, joint)[:-1]
            joint = joint * f.table[tuple(cells[n])]
        total = joint.sum(1, keepdims=True)
        history.append(float((counts * np.log(np.maximum(total[:, 0], 1e-300))).sum()))
        weight = joint / np.maximum(total, 1e-300) * counts[:, None]
        moved = 0.0
        for n in touched:
            c = np.zeros(cpds[n].table.shape)
            np.add.at(c, tuple(cells[n]), weight)
            new = normalise(c, prior)
            if bounds and n in bounds:
                new = normalise(np.clip(new, *bounds[n]))
            moved = max(moved, float(np.abs(new - cpds[n].table).max()))
            cpds[n] = Factor(cpds[n].names, new)
        if moved < tolerance:
            break
    return replace(net, cpds=cpds), history
