"""Gradient-boosted trees for two classes, fitted and scored in numpy, with monotonic constraints."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 64


@dataclass
class Forest:
    """All nodes of all trees one after the other; a leaf leads to itself."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int
    base: float

    def probability(self, rows: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row of features; all trees descend together."""

        at = np.broadcast_to(self.roots, (len(rows), len(self.roots)))
        every = np.arange(len(rows))[:, None]
        for _ in range(self.depth):
            at = np.where(rows[every, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(1))))


def fit(rows: np.ndarray, labels: np.ndarray, constraints: list[int], trees: int = 60, depth: int = 4, rate: float = 0.15, ridge: float = 1.0) -> Forest:
    """Boost ``trees`` trees on the logistic loss.

    ``constraints`` has for each feature 1 where the score may only rise with it, -1 where it may only fall, else 0:
    a split that would turn against it is not made, and both sides of one are held apart at their middle below it.
    With no rows, or one class only, the score is a constant.
    """

    share = float(np.clip(labels.mean(), 1e-3, 1 - 1e-3)) if len(labels) else 0.5
    base = float(np.log(share / (1 - share)))
    nodes: list[list[float]] = []
    roots = []
    if len(np.unique(labels)) == 2:
        cuts = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(rows.shape[1])]
        binned = np.stack([np.searchsorted(c, rows[:, f], "left") for f, c in enumerate(cuts)], 1)
        score = np.full(len(rows), base)
        for _ in range(trees):
            chance = 1 / (1 + np.exp(-score))
            roots.append(len(nodes))
            score += _grow(nodes, binned, cuts, chance - labels, chance * (1 - chance), constraints, depth, rate, ridge)
    if not nodes:
        nodes, roots, base = [[0, np.inf, 0, 0, 0.0]], [0], base if len(labels) else np.inf
    table = np.array(nodes, float)
    return Forest(np.array(roots), table[:, 0].astype(int), table[:, 1], table[:, 2].astype(int), table[:, 3].astype(int), table[:, 4], depth, base)


def _grow(nodes, binned, cuts, slope, curve, constraints, depth, rate, ridge) -> np.ndarray:
    """Add one tree to ``nodes``; returns what it adds to the score of each row."""

    added = np.zeros(len(binned))
    nodes.append([0, np.inf, len(nodes), len(nodes), 0.0])
    todo = [(len(nodes) - 1, np.arange(len(binned)), -np.inf, np.inf, depth)]
    while todo:
        node, rows, low, high, levels = todo.pop()
        best = _best_split(binned[rows], slope[rows], curve[rows], constraints, low, high, ridge) if levels and len(rows) > 20 else None
        if best is None:
            weight = float(np.clip(-slope[rows].sum() / (curve[rows].sum() + ridge), low, high)) * rate
            nodes[node][4] = weight
            added[rows] = weight
            continue
        feature, cut, left_weight, right_weight = best
        goes_left = binned[rows, feature] <= cut
        left, right = len(nodes), len(nodes) + 1
        nodes.extend([[0, np.inf, left, left, 0.0], [0, np.inf, right, right, 0.0]])
        nodes[node][:4] = [feature, cuts[feature][cut], left, right]
        middle = (left_weight + right_weight) / 2
        left_high = min(high, middle) if constraints[feature] > 0 else high
        left_low = max(low, middle) if constraints[feature] < 0 else low
        right_low = max(low, middle) if constraints[feature] > 0 else low
        right_high = min(high, middle) if constraints[feature] < 0 else high
        todo.append((left, rows[goes_left], left_low, left_high, levels - 1))
        todo.append((right, rows[~goes_left], right_low, right_high, levels - 1))
    return added


def _best_split(binned, slope, curve, constraints, low, high, ridge):
    total_slope, total_curve = slope.sum(), curve.sum()
    best, gain = None, 1e-6
    for feature in range(binned.shape[1]):
        g = np.cumsum(np.bincount(binned[:, feature], slope, BINS))[:-1]
        h = np.cumsum(np.bincount(binned[:, feature], curve, BINS))[:-1]
        left = np.clip(-g / (h + ridge), low, high)
        right = np.clip(-(total_slope - g) / (total_curve - h + ridge), low, high)
        better = g**2 / (h + ridge) + (total_slope - g) ** 2 / (total_curve - h + ridge) - total_slope**2 / (total_curve + ridge)
        allowed = (h > 1e-2) & (total_curve - h > 1e-2) & ((right - left) * constraints[feature] >= 0)
        better = np.where(allowed, better, -np.inf)
        at = int(better.argmax())
        if better[at] > gain:
            best, gain = (feature, at, left[at], right[at]), better[at]
    return best
