"""Array expressions: indexed transforms, folds, first hits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def weighted(values: Column, decay: float) -> Column:
    """Each element times decay to the power of its distance from the last one."""
    last = F.size(values) - 1
    return F.transform(values, lambda x, i: x * F.pow(F.lit(decay), (last - i).cast("double")))


def fold(values: Column, scale: float = 1.0) -> Column:
    """Sum of the elements, times ``scale`` at the end."""
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x, lambda acc: acc * scale)


def first_place(values: Column, hit: Callable[[Column], Column]) -> Column:
    """0-based place of the first element that satisfies ``hit``; NULL if none does."""
    marks = F.transform(values, lambda x: F.when(hit(x), 1))
    return F.nullif(F.array_position(marks, F.lit(1)), F.lit(0).cast("bigint")) - 1


def arg_max(values: Column) -> Column:
    """0-based place of the first largest element; NULL for an empty array."""
    place = F.array_position(values, F.array_max(values))
    return F.nullif(place, F.lit(0).cast("bigint")) - 1


def all_above(values: Column, bound: float) -> Column:
    """Whether no element is at or below ``bound``. NaN counts as above."""
    return F.forall(values, lambda x: ~(x <= bound))


def list_quantile(ordered: Column, fraction: float, kind: str) -> Column:
    """A quantile of a sorted list as ``order.SlidingOrder`` gives it, NULL for an empty list."""
    n = F.size(ordered)
    place = (n - 1) * F.lit(fraction)
    if kind == "nearest":
        low = F.floor(place + 0.5)
    elif kind == "lower":
        low = F.greatest(F.ceil(n * F.lit(fraction) - 1e-9) - 1, F.lit(0))
    else:
        low = F.floor(place)
    below = F.get(ordered, low.cast("int"))
    if kind == "linear":
        part = place - low
        below = F.when(part > 0, below + (F.get(ordered, (low + 1).cast("int")) - below) * part).otherwise(below)
    return F.when(n > 0, below)
