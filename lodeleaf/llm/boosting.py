"""Gradient-boosted trees for a yes or no, on few features and a bounded sample; numpy only."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

LEVELS = 4


@dataclass
class Boosted:
    """Complete trees of LEVELS levels; node i has children 2i + 1 and 2i + 2."""

    base: float = 0.0
    features: list[np.ndarray] = field(default_factory=list)
    cuts: list[np.ndarray] = field(default_factory=list)
    leaves: list[np.ndarray] = field(default_factory=list)
    threshold: float = 0.5

    def raw(self, x: np.ndarray) -> np.ndarray:
        if not self.features:
            return np.full(len(x), self.base)
        # all trees of a node's level at once: places in the flattened arrays of nodes and leaves
        n, nodes, ends = len(self.features), 2**LEVELS - 1, 2**LEVELS
        f, c, leaf = np.concatenate(self.features), np.concatenate(self.cuts).astype(np.float32), np.concatenate(self.leaves)
        out = np.empty(len(x))
        x = np.ascontiguousarray(x, dtype=np.float32)
        for a in range(0, len(x), 512):
            part = x[a : a + 512]
            flat, rows = part.ravel(), (np.arange(len(part)) * x.shape[1])[:, None]
            at = np.zeros((len(part), n), dtype=np.int64)
            first = np.arange(n) * nodes
            for _ in range(LEVELS):
                k = at + first
                at = 2 * at + 1 + (flat[rows + f[k]] > c[k])
            out[a : a + 512] = self.base + leaf[at - nodes + np.arange(n) * ends].sum(axis=1)
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 100, rate: float = 0.25, smooth: float = 1.0) -> Boosted:
    """Newton boosting on the log loss; cuts at up to 32 distinct values of a feature.  Equal rows are taken as one."""
    model = Boosted()
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model.base = float(np.log(share / (1 - share)))
    x, inverse = np.unique(x, axis=0, return_inverse=True)
    inverse = inverse.ravel()
    times = np.bincount(inverse, minlength=len(x)).astype(np.float64)
    hits = np.bincount(inverse, y, len(x))
    cuts = [(j, v) for j in range(x.shape[1]) for v in np.unique(np.quantile(x[:, j], np.linspace(0, 1, 33)))[:-1]]
    if not cuts:
        return model
    which, values = np.array([j for j, _ in cuts]), np.array([v for _, v in cuts], dtype=np.float32)
    over = (x[:, which] > values).astype(np.float32)
    score = np.full(len(x), model.base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = hits - times * p, times * p * (1 - p)
        nodes = 2**LEVELS - 1
        features, bounds = np.zeros(nodes, dtype=np.int64), np.full(nodes, np.inf, dtype=np.float32)
        at = np.zeros(len(x), dtype=np.int64)
        for level in range(LEVELS):
            first, n = 2**level - 1, 2**level
            own = np.zeros((2 * n, len(x)), dtype=np.float32)
            own[at - first, np.arange(len(x))] = g
            own[n + at - first, np.arange(len(x))] = h
            right = (own @ over).astype(np.float64)
            whole = own.sum(axis=1, dtype=np.float64)[:, None]
            rg, rh, tg, th = right[:n], right[n:], whole[:n], whole[n:]
            gain = rg**2 / (rh + smooth) + (tg - rg) ** 2 / (th - rh + smooth) - tg**2 / (th + smooth)
            best = np.argmax(gain, axis=1)
            for k in range(n):
                if gain[k, best[k]] > 1e-4:
                    features[first + k], bounds[first + k] = which[best[k]], values[best[k]]
            at = 2 * at + 1 + (x[np.arange(len(x)), features[at]] > bounds[at])
        leaf = at - nodes
        gained = rate * np.bincount(leaf, g, 2**LEVELS) / (np.bincount(leaf, h, 2**LEVELS) + smooth)
        model.features.append(features)
        model.cuts.append(bounds)
        model.leaves.append(gained)
        score += gained[leaf]
    return model


def calibrate(model: Boosted, x: np.ndarray, y: np.ndarray) -> Boosted:
    """Sets the threshold on rows held out: the middle of those whose F1 is within 0.2 % of the best."""
    p = model.probability(x)
    tries = np.linspace(0.1, 0.9, 33)
    f1 = [2 * np.sum((p >= t) & (y == 1)) / max(1, np.sum(p >= t) + np.sum(y == 1)) for t in tries]
    good = tries[np.asarray(f1) >= max(f1) - 0.002]
    model.threshold = float(good[len(good) // 2])
    return model
