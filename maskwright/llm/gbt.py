"""Gradient-boosted trees in numpy: histogram splits, monotonic constraints, flat node arrays for vectorised scoring."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Trees:
    """All trees' nodes one after the other. A leaf's feature is -1 and its children are itself."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Sum of the leaves' values; x <= threshold goes left."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                f = self.feature[node]
                go = x[rows, np.maximum(f, 0)] <= self.threshold[node]
                node = np.where(go, self.left[node], self.right[node])
            out += self.value[node]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.raw(x)) if len(x) else np.zeros(0)


def constant(p: float) -> Trees:
    p = min(max(p, 1e-6), 1 - 1e-6)
    return Trees(float(np.log(p / (1 - p))), np.zeros(0, np.int64), *(np.zeros(0, t) for t in (np.int64, float, np.int64, np.int64, float)), 0)


def fit(
    x: np.ndarray, y: np.ndarray, *, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48, l2: float = 2.0, least: float = 5.0, monotone: dict[int, int] | None = None,
    weight: np.ndarray | None = None, sample: float = 1.0, seed: int = 7,
) -> Trees:
    """Logistic loss. monotone: feature -> +1 (score may not fall as it grows) or -1. Without rows of both kinds: a constant."""
    weight = np.ones(len(y)) if weight is None else weight
    if not len(y) or y.min() == y.max():
        return constant(float(y.mean()) if len(y) else 0.5)
    monotone = monotone or {}
    rng = np.random.default_rng(seed)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)])  # bin b: x <= edges[b]
    p = float((y * weight).sum() / weight.sum())
    base = float(np.log(p / (1 - p)))
    score = np.full(len(y), base)
    roots, feature, threshold, left, right, value = [], [], [], [], [], []

    def leaf(v: float) -> int:
        n = len(feature)
        feature.append(-1), threshold.append(0.0), left.append(n), right.append(n), value.append(v)
        return n

    def best_split(rows, g, h, low, high):
        total_g, total_h = g[rows].sum(), h[rows].sum()
        top = (1e-6, None)
        for f, e in enumerate(edges):
            if not len(e):
                continue
            b = binned[f, rows]
            sg, sh = np.bincount(b, g[rows], len(e) + 1).cumsum()[:-1], np.bincount(b, h[rows], len(e) + 1).cumsum()[:-1]
            rg, rh = total_g - sg, total_h - sh
            vl, vr = np.clip(-sg / (sh + l2), low, high), np.clip(-rg / (rh + l2), low, high)
            gain = -(sg * vl + 0.5 * (sh + l2) * vl**2) - (rg * vr + 0.5 * (rh + l2) * vr**2) - total_g**2 / (2 * (total_h + l2))
            number = np.bincount(b, minlength=len(e) + 1).cumsum()[:-1]
            ok = (number >= least) & (len(rows) - number >= least)
            if f in monotone:
                ok &= monotone[f] * (vr - vl) >= 0
            gain = np.where(ok, gain, -np.inf)
            k = int(np.argmax(gain))
            if gain[k] > top[0]:
                top = (gain[k], (f, k, float(vl[k]), float(vr[k])))
        return top[1]

    def grow(rows, g, h, low, high, level) -> int:
        v = float(np.clip(-g[rows].sum() / (h[rows].sum() + l2), low, high))
        split = best_split(rows, g, h, low, high) if level < depth and len(rows) >= 2 * least else None
        me = leaf(rate * v)
        if split is None:
            return me
        f, k, vl, vr = split
        middle = (vl + vr) / 2
        a, b = (low, high), (low, high)
        if monotone.get(f) == 1:
            a, b = (low, middle), (middle, high)
        elif monotone.get(f) == -1:
            a, b = (middle, high), (low, middle)
        goes = binned[f, rows] <= k
        feature[me], threshold[me] = f, float(edges[f][k])
        left[me] = grow(rows[goes], g, h, *a, level + 1)
        right[me] = grow(rows[~goes], g, h, *b, level + 1)
        return me

    for _ in range(trees):
        q = sigmoid(score)
        g, h = (q - y) * weight, np.maximum(q * (1 - q), 1e-6) * weight
        rows = np.arange(len(y)) if sample >= 1 else np.flatnonzero(rng.random(len(y)) < sample)
        roots.append(grow(rows, g, h, -4.0, 4.0, 0))
        one = Trees(0.0, np.array(roots[-1:]), *(np.array(a) for a in (feature, threshold, left, right, value)), depth)
        score += one.raw(x)
    return Trees(base, np.array(roots), *(np.array(a) for a in (feature, threshold, left, right, value)), depth)


def paths(trees: Trees) -> list[tuple[tuple[int, bool, float], ...]]:
    """The conjunctions (feature, is_at_most, threshold) that lead to each node but the roots, without repetition."""
    out = {}

    def walk(node, held):
        if held:
            tight = {}
            for f, at_most, t in held:
                old = tight.get((f, at_most))
                tight[(f, at_most)] = t if old is None else (min if at_most else max)(old, t)
            out[tuple(sorted((f, a, t) for (f, a), t in tight.items()))] = None
        f = int(trees.feature[node])
        if f >= 0:
            t = float(trees.threshold[node])
            walk(trees.left[node], [*held, (f, True, t)])
            walk(trees.right[node], [*held, (f, False, t)])

    for r in trees.roots:
        walk(r, [])
    return list(out)


def lasso_logistic(x: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Intercept and weights that minimise mean logistic loss + penalty * sum |w|, by accelerated proximal gradient."""
    n, k = x.shape
    w, b, v, c, t = np.zeros(k), 0.0, np.zeros(k), 0.0, 1.0
    if k == 0 or n == 0:
        return 0.0, w
    xs = x.astype(np.float32)
    norm = np.ones(k)
    u = np.random.default_rng(0).normal(size=k)
    for _ in range(15):  # largest eigenvalue of x'x / n
        u = xs.T @ (xs @ u.astype(np.float32)) / n
        norm = np.linalg.norm(u)
        u = u / max(norm, 1e-12)
    step = 1 / (0.25 * (float(norm) + 1) * 1.1)
    for _ in range(rounds):
        r = sigmoid(xs @ v.astype(np.float32) + c) - y
        w2 = v - step * (xs.T @ r.astype(np.float32)) / n
        w2 = np.sign(w2) * np.maximum(np.abs(w2) - step * penalty, 0)
        b2 = c - step * r.mean()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return float(b), w
