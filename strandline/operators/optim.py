"""Optimizers: minimum of a function of one or more numbers.

The objective is a Python callable; where it aggregates a DataFrame, cache the input and pass a
``batch`` objective, which gets all probe points of a gradient at once and so costs one job.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

GOLDEN = (5**0.5 - 1) / 2
STEP, HISTORY = 1e-4, 5


def golden_section(f: Callable[[float], float], low: float, high: float, tolerance: float = 1e-8) -> float:
    """Place of the minimum of a unimodal f; each round evaluates f once."""
    a, b = high - GOLDEN * (high - low), low + GOLDEN * (high - low)
    fa, fb = f(a), f(b)
    while high - low > tolerance:
        if fa < fb:
            high, b, fb = b, a, fa
            a = high - GOLDEN * (high - low)
            fa = f(a)
        else:
            low, a, fa = a, b, fb
            b = low + GOLDEN * (high - low)
            fb = f(b)
    return (low + high) / 2


def many(f: Callable[[np.ndarray], float]) -> Callable[[np.ndarray], np.ndarray]:
    """A batch objective from one for a point."""
    return lambda points: np.array([f(p) for p in points])


def gradient(batch: Callable[[np.ndarray], np.ndarray], x: np.ndarray, step: float = STEP) -> tuple[float, np.ndarray]:
    """Value and forward differences, from one call with all probes."""
    values = batch(np.vstack([x, x + step * np.eye(len(x))]))
    return float(values[0]), (values[1:] - values[0]) / step


def line_search(batch: Callable, x: np.ndarray, direction: np.ndarray, tolerance: float = 1e-7) -> np.ndarray:
    """The best point along a direction: steps double while they improve, then a golden section."""
    f = lambda t: float(batch((x + t * direction)[None])[0])
    here, reach = f(0.0), 1e-3
    best = here
    while (now := f(reach)) < best and reach < 1e6:
        best, reach = now, reach * 2
    t = golden_section(f, 0.0, reach, tolerance * max(1.0, reach))
    return x + t * direction if f(t) < here else x


def gradient_descent(batch: Callable, x, rounds: int = 200, tolerance: float = 1e-7) -> np.ndarray:
    x = np.asarray(x, dtype=float)
    for _ in range(rounds):
        _, g = gradient(batch, x)
        if np.linalg.norm(g) < tolerance:
            break
        new = line_search(batch, x, -g)
        if np.linalg.norm(new - x) < tolerance:
            return new
        x = new
    return x


def lbfgs(batch: Callable, x, rounds: int = 200, tolerance: float = 1e-7, history: int = HISTORY) -> np.ndarray:
    """Limited-memory BFGS with the two-loop recursion."""
    x = np.asarray(x, dtype=float)
    pairs: deque = deque(maxlen=history)
    _, g = gradient(batch, x)
    for _ in range(rounds):
        if np.linalg.norm(g) < tolerance:
            break
        q, kept = g.copy(), []
        for s, y in reversed(pairs):
            a = (s @ q) / (s @ y)
            kept.append(a)
            q -= a * y
        if pairs:
            s, y = pairs[-1]
            q *= (s @ y) / (y @ y)
        for (s, y), a in zip(pairs, reversed(kept), strict=True):
            q += s * (a - (y @ q) / (s @ y))
        new = line_search(batch, x, -q)
        _, after = gradient(batch, new)
        if np.linalg.norm(new - x) < tolerance:
            return new
        if (new - x) @ (after - g) > 1e-12:
            pairs.append((new - x, after - g))
        x, g = new, after
    return x


def over_frame(df: DataFrame, loss: Callable[[list[float]], Column]) -> Callable[[np.ndarray], np.ndarray]:
    """A batch objective: the sum of ``loss(point)`` over the rows, all points in one job."""
    return lambda points: np.array(df.agg(*(F.sum(loss([float(v) for v in p])).alias(f"f{i}") for i, p in enumerate(points))).first(), dtype=float)
