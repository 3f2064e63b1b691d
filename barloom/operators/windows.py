"""Window building blocks: gated rolling aggregates, last valid values, and the recursive mean."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def series(backwards: bool = False) -> Window:
    return Window.partitionBy("symbol").orderBy(F.desc("ts") if backwards else "ts")


def rolling(agg: Callable[[Column], Column], x: Column, n: int, least: int | None = None) -> Column:
    """An aggregate of the last n rows, once ``least`` (n by default) of them aren't null."""
    w = series().rowsBetween(1 - n, 0)
    return F.when(F.count(x).over(w) >= (least or n), agg(x).over(w))


def running(agg: Callable[[Column], Column], x: Column) -> Column:
    return agg(x).over(series().rowsBetween(Window.unboundedPreceding, 0))


def previous(x: str, back: int = 1) -> Column:
    """The value that many places before the last one among a column's non-null values up to this row."""
    before = lambda n: F.expr(f"lag(`{x}`, {n}) IGNORE NULLS OVER (PARTITION BY symbol ORDER BY ts)")
    return F.when(F.col(x).isNotNull(), before(back)).otherwise(before(back + 1))


def ewm(x: np.ndarray, alpha: float, least: int = 0, carry: tuple = (np.nan, 0, 0)) -> np.ndarray:
    """Recursive mean that starts at the first value; after g missing rows the old mean weighs (1 - alpha)^(g + 1).

    It goes on from a ``carry``: the mean so far, the missing rows since its last value, the values seen.
    """
    mean, gap, seen = carry
    before = np.concatenate([[mean], np.full(int(min(gap, 800 / alpha)), np.nan)]) if seen else np.empty(0)  # beyond that the old mean weighs nothing
    out = pd.Series(np.concatenate([before, x])).ewm(alpha=alpha, adjust=False).mean().to_numpy()[len(before):]
    return np.where(np.cumsum(x == x) + seen >= max(1, least), out, np.nan)


def ewm_step(x: np.ndarray, alpha: float) -> np.ndarray:
    """What rows do to a recursive mean: rows, leading missing ones, first value, mean at the end when the first value starts it, what is left there of another start, trailing missing rows, values."""
    at = np.flatnonzero(x == x)
    if not len(at):
        return np.array([len(x), 0, np.nan, np.nan, 1, 0, 0])
    weights = (1 - alpha) ** np.diff(at).astype(float)
    return np.array([len(x), at[0], x[at[0]], ewm(x, alpha)[-1], np.prod(weights / (weights + alpha)), len(x) - 1 - at[-1], len(at)])


def ewm_after(carry: tuple, step: np.ndarray, alpha: float) -> tuple:
    """The carry after the rows of a step."""
    mean, gap, seen = carry
    rows, lead, first, last, left, trail, values = step
    if not values:
        return (mean, gap + rows if seen else 0, seen)
    if seen:
        weight = (1 - alpha) ** (gap + lead + 1)
        last = last + left * ((weight * mean + alpha * first) / (weight + alpha) - first)
    return (last, trail, seen + values)
