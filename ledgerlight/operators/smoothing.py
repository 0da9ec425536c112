"""Additive Holt-Winters smoothing of one short series (runs inside a task, numpy only).

For fixed smoothing weights the one-step errors are linear in the starting level, trend
and season, so the best start is a least-squares solution and only the three weights are
searched: a grid over their whole range, refined around the best point.
"""

from __future__ import annotations

import numpy as np

GRID = 5
REFINEMENTS = 12


def _passes(values: np.ndarray, season: int, weights: np.ndarray):
    """Run the recursions for many weights at once.

    Returns one-step errors as ``(weights, points, 1 + starts)``: column 0 from a zero
    start, the others the effect of each starting state; and the final states likewise.
    """
    alpha, beta, gamma = (weights[:, i, None] for i in range(3))
    count, starts = len(weights), season + 1  # level, trend, season - 1 free seasonal terms
    level = np.zeros((count, 1 + starts))
    trend = np.zeros_like(level)
    level[:, 1], trend[:, 2] = 1.0, 1.0
    seasonal = [np.zeros_like(level) for _ in range(season)]
    for i in range(season - 1):
        seasonal[i][:, 3 + i] = 1.0
        seasonal[-1][:, 3 + i] = -1.0
    errors = np.empty((count, len(values), 1 + starts))
    for t, value in enumerate(values):
        now = seasonal[t % season]
        ahead = level + trend
        error = -(ahead + now)
        error[:, 0] += value
        level = ahead + alpha * error
        trend = trend + beta * error
        seasonal[t % season] = now + gamma * error
        errors[:, t] = error
    return errors, level, trend, seasonal


def _weights(unit: np.ndarray) -> np.ndarray:
    """Unit-cube points as (alpha, beta <= alpha, gamma <= 1 - alpha)."""
    alpha = unit[:, 0]
    return np.stack([alpha, alpha * unit[:, 1], (1 - alpha) * unit[:, 2]], axis=1)


def _lost(values: np.ndarray, season: int, unit: np.ndarray) -> np.ndarray:
    errors = _passes(values, season, _weights(unit))[0]
    base, effect = errors[:, :, 0], errors[:, :, 1:]
    q, _ = np.linalg.qr(effect)
    return (base**2).sum(axis=1) - (np.einsum("ptk,pt->pk", q, base) ** 2).sum(axis=1)


def holt_winters(values: np.ndarray, season: int, horizon: int) -> tuple[np.ndarray, np.ndarray]:
    """Forecast of ``horizon`` steps and the in-sample one-step errors."""
    scale = float(np.abs(values).max()) or 1.0
    scaled = values / scale
    centre, reach = np.full(3, 0.5), 0.5
    for _ in range(REFINEMENTS):
        axes = [np.unique(np.clip(np.linspace(c - reach, c + reach, GRID), 0.0, 1.0)) for c in centre]
        points = np.stack(np.meshgrid(*axes, indexing="ij"), axis=-1).reshape(-1, 3)
        centre = points[int(np.argmin(_lost(scaled, season, points)))]
        reach *= 0.6
    errors, level, trend, seasonal = _passes(scaled, season, _weights(centre[None, :]))
    start = np.linalg.lstsq(errors[0, :, 1:], -errors[0, :, 0], rcond=None)[0]
    mix = np.concatenate([[1.0], start])
    steps = np.arange(1, horizon + 1)
    seasons = np.array([(seasonal[(len(values) + s - 1) % season][0] * mix).sum() for s in steps])
    ahead = (level[0] * mix).sum() + steps * (trend[0] * mix).sum() + seasons
    return ahead * scale, (errors[0] @ mix) * scale
