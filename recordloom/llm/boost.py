"""Gradient-boosted trees of depth two for a handful of integer features, trained on a bounded sample and compiled to SQL."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Boosted:
    """Sum of trees (feature, cut, (feature, cut, low, high), (feature, cut, low, high)), then a logistic calibration."""

    trees: list
    scale: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for f, c, left, right in self.trees:
            low, high = (np.where(x[:, g] <= u, a, b) for g, u, a, b in (left, right))
            out += np.where(x[:, f] <= c, low, high)
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.raw(x) + self.shift, -30, 30)))

    def column(self, names: list[str]) -> Column:
        """The calibrated probability of a row whose features are the columns names."""

        def leaf(split) -> Column:
            g, u, a, b = split
            return F.when(F.col(names[g]) <= u, a).otherwise(b)

        raw = F.lit(0.0)
        for f, c, left, right in self.trees:
            raw = raw + F.when(F.col(names[f]) <= c, leaf(left)).otherwise(leaf(right))
        return 1 / (1 + F.exp(-(self.scale * raw + self.shift)))


def _split(rows: np.ndarray, bins: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray) -> tuple[int, float]:
    """The feature and cut of the largest gain; without any gain, all rows go to the left."""
    best, all_g, all_h = (1e-12, 0, math.inf), g[rows].sum(), h[rows].sum()
    for f, own in enumerate(cuts):
        if not len(own):
            continue
        left_g = np.cumsum(np.bincount(bins[rows, f], g[rows], len(own) + 1))[:-1]
        left_h = np.cumsum(np.bincount(bins[rows, f], h[rows], len(own) + 1))[:-1]
        gain = left_g**2 / (left_h + 1) + (all_g - left_g) ** 2 / (all_h - left_h + 1) - all_g**2 / (all_h + 1)
        if gain.max() > best[0]:
            best = (float(gain.max()), f, float(own[gain.argmax()]))
    return best[1:]


def train(x: np.ndarray, y: np.ndarray, rounds: int = 60, rate: float = 0.3, precision: float = 0.95) -> Boosted:
    """Trees on two thirds of the rows; on the third left out a logistic calibration, and the lowest threshold whose
    precision there is reached."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    held = np.arange(len(x)) % 3 == 0
    fit = np.flatnonzero(~held)
    cuts = [np.unique(c)[:-1] for c in x.T]
    cuts = [c if len(c) <= 16 else c[np.arange(16) * len(c) // 16] for c in cuts]
    bins = np.stack([np.searchsorted(c, v) for c, v in zip(cuts, x.T, strict=True)], axis=1)
    score, trees = np.zeros(len(x)), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        value = lambda rows: float(rate * g[rows].sum() / (h[rows].sum() + 1))  # noqa: E731, B023
        f, c = _split(fit, bins, cuts, g, h)
        leaves = []
        for rows in (fit[x[fit, f] <= c], fit[x[fit, f] > c]):
            k, u = _split(rows, bins, cuts, g, h)
            leaves.append((k, u, value(rows[x[rows, k] <= u]), value(rows[x[rows, k] > u])))
        trees.append((f, c, *leaves))
        score += Boosted(trees[-1:]).raw(x)
    out = Boosted(trees)
    # Platt scaling by gradient steps
    raw, own = out.raw(x[held]), y[held]
    for _ in range(300):
        e = own - 1 / (1 + np.exp(-np.clip(out.scale * raw + out.shift, -30, 30)))
        out.scale, out.shift = out.scale + 5 * float((e * raw).mean()) / 10, out.shift + 5 * float(e.mean()) / 10
    p = out.probability(x[held])
    order = np.argsort(-p, kind="stable")
    good = np.cumsum(own[order]) >= precision * np.arange(1, len(order) + 1)
    fine = np.flatnonzero(good & (p[order] >= 0.5))
    out.threshold = float(p[order][fine[-1]]) if len(fine) else 1.0
    return out
