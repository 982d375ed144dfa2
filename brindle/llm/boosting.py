"""Gradient-boosted regression trees for two classes, fitted on the driver from a bounded sample
and rendered as SQL, so scoring stays inside Spark's expressions."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Node:
    value: float = 0.0
    feature: int = -1
    cut: float = 0.0
    low: Node | None = None
    high: Node | None = None

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.feature < 0:
            return np.full(len(x), self.value)
        below = x[:, self.feature] <= self.cut
        out = np.empty(len(x))
        out[below], out[~below] = self.low.predict(x[below]), self.high.predict(x[~below])
        return out

    def sql(self, names: list[str]) -> str:
        if self.feature < 0:
            return f"{self.value!r}D"
        return f"if({names[self.feature]} <= {self.cut!r}D, {self.low.sql(names)}, {self.high.sql(names)})"


def _grow(x: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, depth: int, least: int, ridge: float) -> Node:
    g, h = gradient.sum(), hessian.sum()
    leaf = Node(value=float(-g / (h + ridge)))
    if depth == 0 or len(x) < 2 * least:
        return leaf
    best, at = 1e-9, None
    for k in range(x.shape[1]):
        order = np.argsort(x[:, k], kind="stable")
        v = x[order, k]
        gs, hs = np.cumsum(gradient[order])[:-1], np.cumsum(hessian[order])[:-1]
        n = np.arange(1, len(x))
        ok = (v[1:] > v[:-1]) & (n >= least) & (len(x) - n >= least)
        if not ok.any():
            continue
        gain = gs**2 / (hs + ridge) + (g - gs) ** 2 / (h - hs + ridge) - g**2 / (h + ridge)
        gain[~ok] = -np.inf
        i = int(np.argmax(gain))
        if gain[i] > best:
            best, at = gain[i], (k, float((v[i] + v[i + 1]) / 2))
    if at is None:
        return leaf
    below = x[:, at[0]] <= at[1]
    return Node(
        feature=at[0],
        cut=at[1],
        low=_grow(x[below], gradient[below], hessian[below], depth - 1, least, ridge),
        high=_grow(x[~below], gradient[~below], hessian[~below], depth - 1, least, ridge),
    )


@dataclass
class Boosted:
    bias: float
    trees: list[Node] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.bias + sum((t.predict(x) for t in self.trees), np.zeros(len(x)))

    def sql(self, names: list[str]) -> str:
        return " + ".join([f"{self.bias!r}D", *(t.sql(names) for t in self.trees)])


def fit(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, rate: float = 0.3, least: int = 8) -> Boosted:
    share = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    model = Boosted(float(np.log(share / (1 - share))))
    margin = np.full(len(y), model.bias)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        tree = _grow(x, p - y, np.maximum(p * (1 - p), 1e-6), depth, least, 1.0)
        _scale(tree, rate)
        model.trees.append(tree)
        margin += tree.predict(x)
    return model


def _scale(node: Node, rate: float) -> None:
    if node.feature < 0:
        node.value *= rate
    else:
        _scale(node.low, rate)
        _scale(node.high, rate)


def threshold(margin: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The lowest margin at and above which calibration rows reach the precision (after one
    pseudo-error, so that few rows can't claim it); infinite if none does."""
    order = np.argsort(-margin, kind="stable")
    m, hits = margin[order], np.cumsum(y[order])
    n = np.arange(1, len(m) + 1)
    good = hits / (n + 1) >= precision
    good[:-1] &= m[:-1] > m[1:]
    return float(m[np.flatnonzero(good)[-1]]) if good.any() else float("inf")
