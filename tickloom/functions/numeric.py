"""Arithmetic that must not raise under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")
NAN = float("nan")


def ieee_div(num: Column, den: Column) -> Column:
    """Floating-point division: x/0 is +-infinity and 0/0 is NaN, instead of an error."""
    return (
        F.when(den != 0, F.try_divide(num, den))
        .when(den.isNull() | num.isNull(), None)
        .when(num > 0, INF)
        .when(num < 0, -INF)
        .otherwise(NAN)
    )


def idiv(num: Column, den: int) -> Column:
    """Whole-number division, exact for any BIGINT; truncates toward zero."""
    return F.call_function("div", num, F.lit(den).cast("bigint"))


def nan_to(col: Column, value: float) -> Column:
    """Replace NaN, leaving NULL alone."""
    return F.when(F.isnan(col), F.lit(value)).otherwise(col)


def rounded(col: Column | str, digits: int = 6) -> Column:
    return F.round(col, digits)
