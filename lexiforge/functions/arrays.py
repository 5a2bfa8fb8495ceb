"""Small helpers over array expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NONE = float("-inf")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def evaluated(df: DataFrame, **values: Column) -> DataFrame:
    """``df`` with new columns that are computed once a row.

    A plain projection may be merged into later ones, and an expression merged into a lambda runs once an element. A
    generator of one element is not merged, nor are filters on its columns pushed below it.
    """
    row = F.struct(*[value.alias(name) for name, value in values.items()])
    return df.select("*", F.inline(F.array(row)))


def minus_infinity() -> Column:
    return F.lit(NONE)


def log_sum_exp(values: Column) -> Column:
    """The logarithm of the sum of exponentials; minus infinity for an empty array or one of minus infinities."""
    top = lambda xs: F.coalesce(F.array_max(xs), minus_infinity())
    total = lambda xs, m: F.aggregate(xs, F.lit(0.0), lambda s, x: s + F.exp(x - m))
    return let(values, lambda xs: let(top(xs), lambda m: F.when(m == minus_infinity(), m).otherwise(m + F.log(total(xs, m)))))
