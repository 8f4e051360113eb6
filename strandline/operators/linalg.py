"""Dense matrices: as arrays of arrays in a row, and in groups of rows with NumPy."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


def add(a: Column, b: Column) -> Column:
    return _by_cell(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return _by_cell(a, b, lambda x, y: x - y)


def multiply_cells(a: Column, b: Column) -> Column:
    return _by_cell(a, b, lambda x, y: x * y)


def divide_cells(a: Column, b: Column) -> Column:
    return _by_cell(a, b, lambda x, y: x / y)


def _by_cell(a: Column, b: Column, f: Callable) -> Column:
    return F.zip_with(a, b, lambda r, s: F.zip_with(r, s, f))


def add_scalar(a: Column, v: float | Column) -> Column:
    return F.transform(a, lambda r: F.transform(r, lambda x: x + v))


def multiply_scalar(a: Column, v: float | Column) -> Column:
    return F.transform(a, lambda r: F.transform(r, lambda x: x * v))


def transpose(a: Column) -> Column:
    return F.transform(F.element_at(a, 1), lambda _, j: F.transform(a, lambda r: F.get(r, j)))


def multiply(a: Column, b: Column) -> Column:
    """Product of small matrices in a row."""
    columns = transpose(b)
    cell = lambda r, c: F.aggregate(F.zip_with(r, c, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(a, lambda r: F.transform(columns, lambda c: cell(r, c)))


def solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x with a x = b, by elimination with partial pivoting."""
    return np.linalg.solve(a, b)


def invert(a: np.ndarray) -> np.ndarray:
    return np.linalg.inv(a)


def cholesky(a: np.ndarray) -> np.ndarray:
    """The lower factor; an error where a is not positive definite."""
    return np.linalg.cholesky(a)


def largest_eigenvalue(a: np.ndarray, tolerance: float = 1e-10, rounds: int = 100_000) -> float:
    """By power iteration with Rayleigh quotients, for a symmetric matrix."""
    x = np.ones(len(a)) / np.sqrt(len(a)) + np.arange(len(a)) * 1e-3
    value = 0.0
    for _ in range(rounds):
        y = a @ x
        n = np.linalg.norm(y)
        if n == 0:
            return 0.0
        x = y / n
        new = float(x @ a @ x)
        if abs(new - value) <= tolerance * max(1.0, abs(new)):
            return new
        value = new
    return value


def by_group(df: DataFrame, keys: Sequence[str], f: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """f on the matrix (i, j, v) of each group; groups must fit a task, as a matrix of n rows has n^2 values."""
    names = list(keys)
    fields = ", ".join(f"{name} {kind}" for name, kind in df.dtypes if name in names)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.zeros((int(pdf.i.max()) + 1, int(pdf.j.max()) + 1))
        m[pdf.i, pdf.j] = pdf.v
        out = np.atleast_2d(f(m))
        i, j = np.indices(out.shape)
        return pd.DataFrame({k: pdf[k].iloc[0] for k in names} | {"i": i.ravel(), "j": j.ravel(), "v": out.ravel()})

    return df.groupBy(*names).applyInPandas(run, f"{fields}, i long, j long, v double")
