"""A logistic model fitted on the driver to a bounded sample of rows."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_logistic(
    x: np.ndarray, y: np.ndarray, l2: float = 1.0, centre: np.ndarray | None = None, rounds: int = 12
) -> tuple[np.ndarray, float]:
    """Weights and intercept for soft labels ``y`` by Newton steps; weights are drawn to ``centre`` (default 0)."""
    rows, columns = x.shape
    design = np.hstack([x, np.ones((rows, 1))]).astype(np.float64)
    base = np.clip(y.mean() if rows else 0.5, 1e-3, 1 - 1e-3)
    anchor = np.zeros(columns + 1)
    if centre is not None:
        anchor[:-1] = centre
    anchor[-1] = np.log(base / (1 - base))
    pull = np.full(columns + 1, l2)
    pull[-1] = 1e-3
    weights = anchor.copy()
    for _ in range(rounds if rows else 0):
        p = sigmoid(design @ weights)
        slope = design.T @ (p - y) + pull * (weights - anchor)
        bend = (design * (p * (1 - p))[:, None]).T @ design + np.diag(pull)
        step = np.linalg.solve(bend, slope)
        step *= min(1.0, 5.0 / max(np.abs(step).max(), 1e-9))
        weights -= step
        if np.abs(step).max() < 1e-5:
            break
    return weights[:-1], float(weights[-1])
