"""A small optimiser for the M-steps on the driver: L-BFGS with backtracking, and the digamma function."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np


def digamma(x: float) -> float:
    """Recurrence up to 6, then the asymptotic series."""
    out = 0.0
    while x < 6:
        out -= 1 / x
        x += 1
    y = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))


def lbfgs(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, max_iter: int = 50, tol: float = 1e-5, history: int = 10) -> np.ndarray:
    """Minimise f, which returns its value and gradient; every iterate is no worse than the one before."""
    x = np.asarray(x, np.float64).copy()
    value, gradient = f(x)
    steps: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(max_iter):
        if np.linalg.norm(gradient) <= tol:
            break
        q, kept = gradient.copy(), []
        for s, y, r in reversed(steps):
            a = r * (s @ q)
            kept.append(a)
            q -= a * y
        if steps:
            s, y, _ = steps[-1]
            q *= (s @ y) / (y @ y)
        for (s, y, r), a in zip(steps, reversed(kept)):
            q += (a - r * (y @ q)) * s
        slope = -(gradient @ q)
        if not slope < 0:
            q, slope = gradient.copy(), -(gradient @ gradient)
            steps.clear()
        length = 1.0 if steps else min(1.0, 1.0 / max(np.abs(gradient).sum(), 1e-12))
        for _ in range(40):
            new = x - length * q
            new_value, new_gradient = f(new)
            if np.isfinite(new_value) and new_value <= value + 1e-4 * length * slope:
                break
            length /= 2
        else:
            break
        s, y = new - x, new_gradient - gradient
        if s @ y > 1e-12 * np.linalg.norm(s) * np.linalg.norm(y):
            steps = [*steps[-(history - 1) :], (s, y, 1 / (s @ y))]
        done = abs(value - new_value) <= 1e-12 * max(1.0, abs(value))
        x, value, gradient = new, new_value, new_gradient
        if done:
            break
    return x
