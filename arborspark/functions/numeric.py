"""Numeric rules that differ between languages, pinned down as column expressions.

log10(0) is minus infinity, x / 0 an infinity of x's sign, and 0 / 0 null.
Negative zeros become zeros.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INFINITY = float("inf")


def log10(x: Column) -> Column:
    return F.when(x == 0, F.lit(-INFINITY)).when(x > 0, F.log10(x))


def ratio(a: Column, b: Column) -> Column:
    a, b = a.cast("double"), b.cast("double")
    whole = F.when(b != 0, a / F.when(b != 0, b))
    return whole.when((b == 0) & (a > 0), F.lit(INFINITY)).when((b == 0) & (a < 0), F.lit(-INFINITY))


def plain_zero(x: Column) -> Column:
    return x + F.lit(0.0)


def quantile(sorted_values: Column, p: float | Column) -> Column:
    """Of an ascending array: the value at (n - 1) p, or the mean of the two around it; null for an empty array.

    The coordinate is rounded to nine digits first, so that k / (n - 1) hits the k-th value.
    """
    at = F.round((F.size(sorted_values) - 1) * (F.lit(p) if not isinstance(p, Column) else p), 9)
    low, high = (F.get(sorted_values, f(at).cast("int")).cast("double") for f in (F.floor, F.ceil))
    return F.when(F.size(sorted_values) > 0, (low + high) / 2)
