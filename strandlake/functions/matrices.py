"""Matrices as columns of array<array<double>>."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def transpose(m: Column) -> Column:
    rows = F.sequence(F.lit(0), F.size(m[0]) - 1)
    return F.when(F.size(m) > 0, F.transform(rows, lambda j: F.transform(m, lambda r: r[j])))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.zip_with(x, y, lambda u, v: u + v))


def _numpy(f: Callable[[np.ndarray, np.ndarray], np.ndarray], kind: str, a: Column, b: Column) -> Column:
    @F.pandas_udf(kind)
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            made = None if x is None or y is None else f(np.array([list(r) for r in x], float), np.array([list(r) if np.ndim(r) else r for r in y], float))
            out.append(None if made is None else made.tolist())
        return pd.Series(out, dtype=object)

    return run(a, b)


def multiply(a: Column, b: Column) -> Column:
    """The product; null where a matrix is."""
    return _numpy(lambda x, y: x @ y, "array<array<double>>", a, b)


def solve(a: Column, b: Column) -> Column:
    """x of a x = b for a vector b; null where either is or a has no inverse."""

    def one(x: np.ndarray, y: np.ndarray) -> np.ndarray | None:
        try:
            return np.linalg.solve(x, y)
        except np.linalg.LinAlgError:
            return None

    return _numpy(one, "array<double>", a, b)
