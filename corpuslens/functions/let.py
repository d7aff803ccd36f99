"""Evaluate an expression once and use its value several times inside higher-order functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    A column used inside a lambda is an expression that would be evaluated again for every element; bound
    as a lambda variable it is not.
    """
    return F.transform(F.array(value), body)[0]


def open_array(df: DataFrame, keep: list, items: Column, pos: str, item: str) -> DataFrame:
    """One row per array element with its 0-based position.

    An inner explode of a computed array makes the optimizer test the whole expression in a filter of its
    own first, so it would be computed several times per row; the outer form is computed once, and rows
    without elements are dropped afterwards.
    """
    return df.select(*keep, F.posexplode_outer(items).alias(pos, item)).filter(F.col(pos).isNotNull())
