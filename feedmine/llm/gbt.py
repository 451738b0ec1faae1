"""Gradient-boosted trees with monotonic constraints, trained and scored with numpy.

Training uses histograms of quantile bins and second-order steps of the logistic loss. A
constrained feature may only move the score one way: splits that would break this are not
taken, and the middle of the two sides bounds every value below them. All trees lie in
five flat node arrays, so scoring walks all rows of a batch one level at a time.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Forest:
    """Nodes of all trees. A leaf has feature -1 and points to itself."""

    base: float
    depth: int
    roots: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    feature: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    threshold: np.ndarray = field(default_factory=lambda: np.zeros(0))
    left: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    right: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    value: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of class 1 for each row."""
        margin = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                goes_left = x[rows, np.maximum(self.feature[node], 0)] <= self.threshold[node]
                node = np.where(goes_left, self.left[node], self.right[node])
            margin += self.value[node]
        return 1 / (1 + np.exp(-margin))


def train(x: np.ndarray, y: np.ndarray, monotone: dict[int, int] | None = None, trees: int = 60, depth: int = 3,
          rate: float = 0.2, l2: float = 1.0, least_hessian: float = 1.0, bins: int = 64) -> Forest:
    """A forest for classes 0 and 1. ``monotone``: feature number to +1 (a greater value never lowers the
    score) or -1. With one class only, or no rows, nothing can be told apart: the forest has no tree and base 0."""
    n, width = x.shape
    if n == 0 or y.min() == y.max():
        return Forest(0.0, depth)
    share = (y.sum() + 0.5) / (n + 1)
    forest = Forest(float(np.log(share / (1 - share))), depth)
    sign = np.zeros(width, int)
    for k, way in (monotone or {}).items():
        sign[k] = way
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(cuts)], axis=1)
    flat = binned + np.arange(width) * bins
    nodes: list[list] = []
    margin = np.full(n, forest.base)

    def best_split(g, h, low, high):
        """(gain, feature, bin, left value, right value) from the sums of each bin."""
        gl, hl = g.cumsum(axis=1)[:, :-1], h.cumsum(axis=1)[:, :-1]
        gr, hr = g.sum(axis=1, keepdims=True) - gl, h.sum(axis=1, keepdims=True) - hl
        vl, vr = (np.clip(-a / (b + l2), low, high) for a, b in ((gl, hl), (gr, hr)))
        loss = lambda a, b, v: a * v + 0.5 * (b + l2) * v * v
        total_g, total_h = g[0].sum(), h[0].sum()
        gain = loss(total_g, total_h, np.clip(-total_g / (total_h + l2), low, high)) - loss(gl, hl, vl) - loss(gr, hr, vr)
        broken = ((vr - vl) * sign[:, None] < 0) | (hl < least_hessian) | (hr < least_hessian)
        gain = np.where(broken, -np.inf, gain)
        k, b = np.unravel_index(int(gain.argmax()), gain.shape)
        return gain[k, b], int(k), int(b), vl[k, b], vr[k, b]

    def grow(rows, g, h, level, low, high) -> int:
        at = len(nodes)
        value = float(np.clip(-g[rows].sum() / (h[rows].sum() + l2), low, high))
        nodes.append([-1, 0.0, at, at, rate * value])
        if level < depth and len(rows) > 1:
            sums = [np.bincount(flat[rows].ravel(), np.repeat(w[rows], width), width * bins).reshape(width, bins) for w in (g, h)]
            gain, k, b, vl, vr = best_split(*sums, low, high)
            if gain > 1e-6 and b < len(cuts[k]):
                middle = (vl + vr) / 2
                # The side that must stay below gets the middle as its upper bound.
                bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}[int(sign[k])]
                goes_left = binned[rows, k] <= b
                nodes[at][:2] = [k, float(cuts[k][b])]
                nodes[at][2] = grow(rows[goes_left], g, h, level + 1, *bounds[0])
                nodes[at][3] = grow(rows[~goes_left], g, h, level + 1, *bounds[1])
                return at
        margin[rows] += rate * value
        return at

    roots = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        roots.append(grow(np.arange(n), p - y, np.maximum(p * (1 - p), 1e-6), 0, -8.0, 8.0))
    columns = list(zip(*nodes, strict=True))
    return Forest(forest.base, depth, np.array(roots, np.int32), np.array(columns[0], np.int32), np.array(columns[1]),
                  np.array(columns[2], np.int32), np.array(columns[3], np.int32), np.array(columns[4]))
