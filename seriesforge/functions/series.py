"""Column functions over ``array<double>`` series.

Sums are explicit left folds: a fold has one order of additions, so its result
is the same bit for bit in every engine, which a parallel aggregate is not.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def fold_sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v)


def series_mean(x: Column) -> Column:
    """Mean of a series; null for an empty one."""
    return F.when(F.size(x) > 0, fold_sum(x) / F.size(x))


def series_std(x: Column, mean: Column) -> Column:
    """Population standard deviation around ``mean``; null for an empty series."""
    sq = F.aggregate(x, F.lit(0.0), lambda acc, v: acc + (v - mean) * (v - mean))
    return F.when(F.size(x) > 0, F.sqrt(sq / F.size(x)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it.

    A lambda variable is bound once; a column would be inlined by the optimizer
    into every use, here into every element of an array.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def znorm(x: Column) -> Column:
    """``(x - mean) / std``; a constant series becomes zeros."""
    scaled = lambda m, sd: F.transform(x, lambda v: F.when(sd > 0, (v - m) / F.nullif(sd, F.lit(0.0))).otherwise(F.lit(0.0)))
    return let(series_mean(x), lambda m: let(series_std(x, m), lambda sd: scaled(m, sd)))


def as_doubles(x: Column) -> Column:
    return x.cast("array<double>")


def is_clean(x: Column) -> Column:
    """True where the series is not null and holds neither null nor NaN nor infinity."""
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf")))
    return x.isNotNull() & ~F.coalesce(F.exists(x, bad), F.lit(True))
