"""Minimisers without scipy: adaptive Nelder-Mead, and BFGS on finite differences."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np


@dataclass
class Found:
    x: np.ndarray
    f: float
    iterations: int
    evaluations: int
    converged: bool


def each(f: Callable[[np.ndarray], float], points) -> np.ndarray:
    """f at several points, at once if it has a way to."""
    return np.array(f.many(list(points)) if hasattr(f, "many") else [f(p) for p in points])


def nelder_mead(f: Callable[[np.ndarray], float], x0: np.ndarray, tol: float, maxiter: int) -> Found:
    """Coefficients by dimension; stops when the values of the simplex spread by less than tol."""
    n = len(x0)
    reflect, expand, contract, shrink = 1.0, 1 + 2 / n, 0.75 - 1 / (2 * n), 1 - 1 / n
    if n == 1:
        expand, contract, shrink = 2.0, 0.5, 0.5
    points = np.vstack([x0, x0 + np.diag(0.5 * np.abs(x0) + 0.1)])
    values = each(f, points)
    calls = n + 1
    for it in range(1, maxiter + 1):
        order = np.argsort(values, kind="stable")
        points, values = points[order], values[order]
        if values.std() < tol:
            return Found(points[0], float(values[0]), it, calls, True)
        mid = points[:-1].mean(0)
        away = mid - points[-1]
        r = mid + reflect * away
        fr = f(r)
        calls += 1
        if fr < values[0]:
            e = mid + expand * away
            fe = f(e)
            calls += 1
            points[-1], values[-1] = (e, fe) if fe < fr else (r, fr)
        elif fr < values[-2]:
            points[-1], values[-1] = r, fr
        else:
            c = mid + (contract if fr < values[-1] else -contract) * away
            fc = f(c)
            calls += 1
            if fc < min(fr, values[-1]):
                points[-1], values[-1] = c, fc
            else:
                points[1:] = points[0] + shrink * (points[1:] - points[0])
                values[1:] = each(f, points[1:])
                calls += n
    best = int(values.argmin())
    return Found(points[best], float(values[best]), maxiter, calls, False)


def bfgs(f: Callable[[np.ndarray], float], x0: np.ndarray, tol: float, maxiter: int, step: float = 1e-6) -> Found:
    """Central differences, inverse-Hessian updates, backtracking."""
    calls, n = 0, len(x0)

    def value(x):
        nonlocal calls
        calls += 1
        return f(x)

    def gradient(x):
        h = step * np.maximum(1, np.abs(x))
        nonlocal calls
        calls += 2 * n
        at = each(f, [p for e in np.diag(h) for p in (x + e, x - e)])
        return (at[::2] - at[1::2]) / (2 * h)

    x, fx, inverse = x0.copy(), value(x0), np.eye(n)
    g = gradient(x)
    for it in range(1, maxiter + 1):
        if np.abs(g).max() <= tol:
            return Found(x, fx, it, calls, True)
        d = -inverse @ g
        if d @ g >= 0:
            inverse, d = np.eye(n), -g
        size = min(1.0, 2.0 / max(1e-12, np.abs(d).max()))
        while (new := value(x + size * d)) > fx + 1e-4 * size * (d @ g) and size > 1e-10:
            size /= 2
        if new >= fx:
            return Found(x, fx, it, calls, np.abs(g).max() <= 10 * tol)
        s = size * d
        x, fx = x + s, new
        after = gradient(x)
        y, g = after - g, after
        if (sy := float(s @ y)) > 1e-12:
            a = np.eye(n) - np.outer(s, y) / sy
            inverse = a @ inverse @ a.T + np.outer(s, s) / sy
    return Found(x, fx, maxiter, calls, False)
