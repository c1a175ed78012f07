"""Gradient boosted trees for two classes on small tables of numbers, with calibrated probabilities."""
from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Tree:
    """A complete tree: node k has the children 2k + 1 and 2k + 2; leaves hold steps of the score."""

    feature: np.ndarray
    above: np.ndarray  # goes to the second child if the feature is greater
    steps: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        while len(x) and node[0] < len(self.feature):
            node = 2 * node + 1 + (x[rows, self.feature[node]] > self.above[node])
        return self.steps[node - len(self.feature)]


@dataclass
class Boosted:
    """Sum of trees, put on the scale of probabilities by ``slope`` and ``shift``, and the least one that counts."""

    start: float = 0.0
    trees: list[Tree] = field(default_factory=list)
    slope: float = 1.0
    shift: float = 0.0
    threshold: float = 1.1  # nothing passes before it is calibrated

    def raw(self, x: np.ndarray) -> np.ndarray:
        return sum((tree(x) for tree in self.trees), np.full(len(x), self.start))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * self.raw(x) + self.shift)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _tree(x: np.ndarray, edges: list[np.ndarray], bins: np.ndarray, slope: np.ndarray, bend: np.ndarray, depth: int, rate: float, ridge: float) -> Tree:
    inner = 2**depth - 1
    feature, above = np.zeros(inner, np.int64), np.full(inner, np.inf)
    node = np.zeros(len(x), np.int64)
    for at in range(inner):
        here = np.flatnonzero(node == at)
        best = 1e-9
        g, h = slope[here], bend[here]
        total = g.sum() ** 2 / (h.sum() + ridge)
        for f, cuts in enumerate(edges):
            if not len(cuts) or not len(here):
                continue
            sums_g = np.cumsum(np.bincount(bins[here, f], g, len(cuts) + 1))[:-1]
            sums_h = np.cumsum(np.bincount(bins[here, f], h, len(cuts) + 1))[:-1]
            gain = sums_g**2 / (sums_h + ridge) + (g.sum() - sums_g) ** 2 / (h.sum() - sums_h + ridge) - total
            k = int(gain.argmax())
            if gain[k] > best:
                best, feature[at], above[at] = gain[k], f, cuts[k]
        node[here] = 2 * at + 1 + (x[here, feature[at]] > above[at])
    leaf = node - inner
    steps = -rate * np.bincount(leaf, slope, inner + 1) / (np.bincount(leaf, bend, inner + 1) + ridge)
    return Tree(feature, above, steps)


def boosted(x: np.ndarray, y: np.ndarray, rounds: int = 50, depth: int = 3, rate: float = 0.25, ridge: float = 1.0, most_bins: int = 32) -> Boosted:
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Boosted(float(np.log(share / (1 - share))))
    edges = []
    for column in x.T:
        values = np.unique(column)
        if len(values) > most_bins:
            values = np.unique(np.quantile(column, np.linspace(0, 1, most_bins + 1)))
        edges.append(values[:-1])
    bins = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1)
    score = np.full(len(x), model.start)
    for _ in range(rounds):
        p = sigmoid(score)
        tree = _tree(x, edges, bins, p - y, p * (1 - p), depth, rate, ridge)
        model.trees.append(tree)
        score += tree(x)
    return model


def calibrate(model: Boosted, x: np.ndarray, y: np.ndarray, precision: float) -> None:
    """Slope and shift by logistic regression on rows not trained on; the threshold is the least
    probability from which on the share of true ones among these rows is ``precision`` or more."""
    raw = model.raw(x)
    w = np.array([1.0, 0.0])
    design = np.stack([raw, np.ones_like(raw)], axis=1)
    soft = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    for _ in range(60):
        p = sigmoid(design @ w)
        step = np.linalg.solve((design.T * (p * (1 - p))) @ design + np.eye(2), design.T @ (p - soft) + (w - [1, 0]))
        w = w - step / max(1.0, 4 * float(np.abs(step).max()))  # short steps, as classes may be far apart
    model.slope, model.shift = max(float(w[0]), 0.1), float(w[1])
    p = model.probability(x)
    order = np.argsort(-p, kind="stable")
    right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    good = np.flatnonzero((right >= precision) & (p[order] >= 0.5))
    if len(good):
        model.threshold = float(p[order][good[-1]])
