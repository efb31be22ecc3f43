"""Small column helpers that pin down NULL handling."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def strict(agg: Callable[[Column], Column], column: str | Column) -> Column:
    """Aggregate that is NULL as soon as one input is NULL (Spark's own skip NULLs)."""
    c = F.col(column) if isinstance(column, str) else column
    return F.when(F.count(c) == F.count(F.lit(1)), agg(c))


def nan_to_null(column: str | Column) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.when(~F.isnan(c), c)


def ratio(top: Column, bottom: Column) -> Column:
    """Quotient that is NULL for a zero denominator."""
    return F.try_divide(top, bottom)


def round_half_even(column: str | Column) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.bround(c, 0).cast("long")


def value_at(column: str | Column, at: Column) -> Column:
    """The value on the row where ``at`` holds; NULL if no row of the group does."""
    c = F.col(column) if isinstance(column, str) else column
    return F.max(F.when(at, c))


def same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Join condition in which NULL keys match each other."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys], F.lit(True))


def salt(columns: Sequence[str], parts: int) -> Column:
    """Repeatable row salt (a hash of the row's own columns, so a retried task draws the same one)."""
    return F.pmod(F.xxhash64(*[F.col(c) for c in columns]), F.lit(parts)).cast("int")
