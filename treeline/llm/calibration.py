"""Isotonic calibration from bounded score histograms."""

from __future__ import annotations

import numpy as np


def pooled(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> list[tuple[list[int], float]]:
    """Pool adjacent violators: (members, weighted mean of y) of blocks with non-decreasing values, by x."""
    blocks: list[tuple[list[int], float, float]] = []
    for i in np.argsort(x, kind="stable").tolist():
        if w[i] <= 0:
            continue
        now = ([i], float(w[i]), float(w[i] * y[i]))
        while blocks and blocks[-1][2] * now[1] >= now[2] * blocks[-1][1]:
            last = blocks.pop()
            now = (last[0] + now[0], last[1] + now[1], last[2] + now[2])
        blocks.append(now)
    return [(i, s / n) for i, n, s in blocks]


def pav(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Block positions (weighted mean x) and non-decreasing block values."""
    blocks = pooled(x, y, w)
    return np.array([np.average(x[i], weights=w[i]) for i, _ in blocks]), np.array([v for _, v in blocks])


def isotonic(
    scores: np.ndarray, labels: np.ndarray, bins: int = 512, prior: float = 1.0, weights: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Knots of a calibration curve from quantile bins of scores. Each block of pooled bins is shrunk to the base
    rate and has a knot at its first and at its last bin, so the curve is flat within blocks. A row counts with
    its weight in every rate, and as one row where a block is held against the prior."""
    if not len(scores):
        return np.array([0.0]), np.array([0.0])
    weights = np.ones(len(scores)) if weights is None else weights
    edges = np.unique(np.quantile(scores, np.linspace(0, 1, bins + 1)))
    at = np.clip(np.searchsorted(edges, scores, side="right") - 1, 0, max(0, len(edges) - 2))
    rows = np.bincount(at, minlength=len(edges)).astype(float)
    n = np.bincount(at, weights, minlength=len(edges))
    hit = np.bincount(at, labels * weights, minlength=len(edges))
    some = np.where(rows > 0, n, 1.0)
    mid = np.bincount(at, scores * weights, minlength=len(edges)) / some
    base = float(np.average(labels, weights=weights))
    x, y = [], []
    for members, value in pooled(mid, hit / some, n):
        seen = rows[members].sum()
        shrunk = (value * seen + prior * base) / (seen + prior)
        for place in dict.fromkeys((mid[members[0]], mid[members[-1]])):
            x.append(float(place))
            y.append(float(np.clip(shrunk, 0, 1)))
    return np.array(x), np.maximum.accumulate(np.array(y))


def apply(x: np.ndarray, y: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """Calibrated values by linear interpolation between knots, constant outside."""
    return np.interp(scores, x, y)
