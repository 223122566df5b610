"""Estimators with fit and predict over acyclic graphs, simulation from fitted graphs, and bootstrap over imputations."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .discovery import multi_group_lingam
from .generators import parents_first
from .kernels import dynamic_graph
from .variants import glm


def plain_graph(x: np.ndarray, penalty: float = 0.02, threshold: float = 0.05) -> np.ndarray:
    """A linear acyclic graph of standardised columns."""
    z = (x - x.mean(0)) / np.maximum(x.std(0), 1e-12)
    return dynamic_graph(z.T @ z / len(z), z.shape[1], np.eye(z.shape[1], dtype=bool), penalty, penalty, threshold=threshold)[0]


class GraphRegressor:
    """Predicts y from its parents in a graph fitted to the features and y; y leads to no feature."""

    def __init__(self, penalty: float = 0.02, threshold: float = 0.05):
        self.penalty, self.threshold = penalty, threshold

    def fit(self, x: np.ndarray, y: np.ndarray) -> GraphRegressor:
        both = np.column_stack([x, y])
        d = both.shape[1]
        z = (both - both.mean(0)) / np.maximum(both.std(0), 1e-12)
        forbidden = np.eye(d, dtype=bool)
        forbidden[-1] = True
        self.graph_ = dynamic_graph(z.T @ z / len(z), d, forbidden, self.penalty, self.penalty, threshold=self.threshold)[0]
        parents = np.flatnonzero(self.graph_[:-1, -1])
        self.coef_ = np.zeros(d - 1)
        if len(parents):
            self.coef_[parents] = np.linalg.lstsq(x[:, parents] - x[:, parents].mean(0), y - y.mean(), rcond=None)[0]
        self.intercept_ = float(y.mean() - x.mean(0) @ self.coef_)
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return x @ self.coef_ + self.intercept_


class GraphClassifier(GraphRegressor):
    """Two classes: a logistic model on the parents of the class's 0/1 column."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> GraphClassifier:
        self.classes_ = np.unique(y)
        if len(self.classes_) != 2:
            raise ValueError("two classes are needed")
        t = (y == self.classes_[1]).astype(float)
        super().fit(x, t)
        parents = np.flatnonzero(self.coef_)
        b = glm(x[:, parents], t, "binary")
        self.coef_ = np.zeros(x.shape[1])
        self.coef_[parents], self.intercept_ = b[1:], float(b[0])
        return self

    def predict_probability(self, x: np.ndarray) -> np.ndarray:
        p = 1 / (1 + np.exp(-np.clip(x @ self.coef_ + self.intercept_, -30, 30)))
        return np.column_stack([1 - p, p])

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.classes_[(self.predict_probability(x)[:, 1] >= 0.5).astype(int)]


class LeastSquares:
    """The default model of a node: fit and predict."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> LeastSquares:
        self.mean, self.centre = y.mean(), x.mean(0)
        self.slope = np.linalg.lstsq(x - self.centre, y - self.mean, rcond=None)[0]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.mean + (x - self.centre) @ self.slope


class GraphSimulator:
    """A model per node on its parents; new data from shuffled residuals, with changed inputs or models.

    ``graph[i, j]`` other than 0 makes i a parent of j; ``model()`` gives an object with fit and predict.
    """

    def __init__(self, graph: np.ndarray, model: Callable = LeastSquares):
        self.graph, self.model = graph, model

    def fit(self, x: np.ndarray) -> GraphSimulator:
        self.x, self.models, self.left = x, {}, x.copy()
        for j in parents_first(self.graph):
            up = np.flatnonzero(self.graph[:, j])
            if len(up):
                self.models[j] = self.model().fit(x[:, up], x[:, j])
                self.left[:, j] = x[:, j] - self.models[j].predict(x[:, up])
        return self

    def simulate(self, seed: int = 0, inputs: dict[int, np.ndarray] | None = None, models: dict[int, object] | None = None, shuffle: bool = True) -> np.ndarray:
        """``inputs`` replace a node without parents; ``models`` replace a node's model."""
        rng, out = np.random.default_rng(seed), np.empty_like(self.x)
        for j in parents_first(self.graph):
            up = np.flatnonzero(self.graph[:, j])
            rest = rng.permutation(self.left[:, j]) if shuffle else self.left[:, j]
            if inputs and j in inputs:
                out[:, j] = inputs[j]
            elif len(up):
                out[:, j] = (models or {}).get(j, self.models[j]).predict(out[:, up]) + rest
            else:
                out[:, j] = rest
        return out


def regression_imputer(x: np.ndarray, rng: np.random.Generator, rounds: int = 5) -> np.ndarray:
    """Missing cells from regressions on the other columns plus a drawn residual, a few rounds from column means."""
    gone = np.isnan(x)
    out = np.where(gone, np.nanmean(x, 0), x)
    for _ in range(rounds):
        for j in np.flatnonzero(gone.any(0)):
            rest = np.delete(out, j, 1)
            seen = ~gone[:, j]
            m = LeastSquares().fit(rest[seen], x[seen, j])
            left = x[seen, j] - m.predict(rest[seen])
            out[~seen, j] = m.predict(rest[~seen]) + rng.choice(left, (~seen).sum())
    return out


def bootstrap_with_imputation(x: np.ndarray, replicates: int, imputations: int = 3, seed: int = 0, impute: Callable = regression_imputer, fit: Callable = multi_group_lingam) -> list[np.ndarray]:
    """Mean effects of each replicate: rows drawn again, imputed a few times, and fitted together under one order."""
    rng, out = np.random.default_rng(seed), []
    for _ in range(replicates):
        some = x[rng.integers(0, len(x), len(x))]
        bs, _ = fit([impute(some, rng) for _ in range(imputations)])
        out.append(np.mean(bs, axis=0))
    return out


def tune(x: np.ndarray, candidates: list[Callable[[np.ndarray], np.ndarray]], folds: int = 5, tolerance: float = 0.01) -> tuple[int, list[float]]:
    """(choice, scores) of graph learners by out-of-sample prediction of every variable from its Markov blanket.

    A score is the mean of -1/2 ln(1 - r^2) over variables and folds of rows in
    order; of learners within ``tolerance`` of the best, the one with the smallest
    blankets counts.
    """
    d, cuts = x.shape[1], np.array_split(np.arange(len(x)), folds)
    scores, sizes = [], []
    for learn in candidates:
        total, size = 0.0, 0
        for test in cuts:
            train = np.setdiff1d(np.arange(len(x)), test)
            g = np.nan_to_num(learn(x[train])) != 0
            blanket = g | g.T | (g.astype(int) @ g.T.astype(int) > 0)
            np.fill_diagonal(blanket, False)
            size += int(blanket.sum())
            for j in range(d):
                use = np.flatnonzero(blanket[:, j])
                if len(use):
                    p = LeastSquares().fit(x[np.ix_(train, use)], x[train, j]).predict(x[np.ix_(test, use)])
                    r = np.corrcoef(p, x[test, j])[0, 1] if p.std() > 1e-12 else 0.0
                    total += -0.5 * np.log(max(1 - r * r, 1e-12)) if r > 0 else 0.0
        scores.append(total / (d * folds))
        sizes.append(size)
    near = [k for k, s in enumerate(scores) if s >= max(scores) - tolerance]
    return min(near, key=lambda k: (sizes[k], k)), scores
