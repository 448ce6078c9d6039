"""Small dense logistic regression on soft labels, fitted on the driver."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35.0, 35.0)))


def fit(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, steps: int = 300, rate: float = 0.1) -> np.ndarray:
    """Weights (the last is the bias) of a logistic regression of ``y`` in [0, 1] on ``x``."""
    n, d = x.shape
    w, m, v = np.zeros(d + 1), np.zeros(d + 1), np.zeros(d + 1)
    if not n:
        return w
    mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    w[-1] = np.log(mean / (1 - mean))
    for t in range(1, steps + 1):
        r = sigmoid(x @ w[:-1].astype(x.dtype) + w[-1]) - y
        g = np.append(r.astype(x.dtype) @ x / n + l2 * w[:-1], r.mean())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def fit_newton(x: np.ndarray, y: np.ndarray, l2: float = 1e-4, rounds: int = 25) -> np.ndarray:
    """The same by Newton's method, for few features."""
    n, d = x.shape
    w = np.zeros(d + 1)
    if not n:
        return w
    x = np.concatenate([x.astype(np.float64), np.ones((n, 1))], 1)
    penalty = np.full(d + 1, l2 * n)
    penalty[-1] = 1e-9
    mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    w[-1] = np.log(mean / (1 - mean))
    for _ in range(rounds):
        p = sigmoid(x @ w)
        g = x.T @ (p - y) + penalty * w
        h = (x * np.maximum(p * (1 - p), 1e-4)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return w
