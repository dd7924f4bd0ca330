"""Exponential smoothing as column expressions over a block window."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from tickloom.plans.layout import offset

# Weights below this share of the newest one are beyond double precision.
NEGLIGIBLE = 1e-20
# Weights lie between exp(-this) and exp(this); a double reaches to 709, which leaves room for the
# values themselves (up to 1e40 in size) and their sums.
LARGEST_EXPONENT = 600.0
# Share left outside a truncated average. Fixed value.
TRUNCATION = 0.001


@dataclass(frozen=True)
class Smoothing:
    """Constants of one exponential average: weight of the new value, and decay."""

    weight: float
    decay: float

    @staticmethod
    def of(period: int, kind: str) -> "Smoothing":
        if kind == "standard":
            return Smoothing(2 / (period + 1), (period - 1) / (period + 1))
        if kind == "wilder":
            return Smoothing(1 / period, (period - 1) / period)
        raise ValueError(f"unknown smoothing kind {kind!r}")

    def lookback(self) -> int:
        """Bars until the decay is down to the truncation share."""
        return math.ceil(math.log(TRUNCATION) / math.log(self.decay))


def lookback_of(period: int, kind: str, period_as_lookback: bool = False) -> int:
    return period if period_as_lookback else Smoothing.of(period, kind).lookback()


def log_growth(com: float) -> float:
    """ln(1/a) for a = 1 - 1/(1 + com)."""
    return math.log((1 + com) / com)


def ewm_reach(com: float) -> int:
    """Bars that still count in double precision."""
    return math.ceil(-math.log(NEGLIGIBLE) / log_growth(com)) if com > 0 else 0


def ewm_span(com: float) -> int | None:
    """Rows from the first whose result is used to the last copy, before the growing weights overflow."""
    return int(2 * LARGEST_EXPONENT / log_growth(com)) if com > 0 else None


def finite(value: Column) -> Column:
    """The value, or NULL in place of NaN and infinity."""
    x = value.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def growing(growth: float) -> Column:
    """Weights growing along the block by exp(growth) a row, the same whatever copies a block has.

    They start low in the first row whose result is used. Rows further back have weights near or at zero.
    """
    return F.exp(offset().cast("double") * F.lit(growth) - F.lit(LARGEST_EXPONENT))


def ewm_sum(value: Column, com: float, window: WindowSpec) -> Column:
    """Sum of the finite values with weights growing along the block; the common factor is left in."""
    running = window.rowsBetween(Window.unboundedPreceding, 0)
    return F.sum(finite(value) * growing(log_growth(com))).over(running)


def ewm(value: Column, com: float, window: WindowSpec) -> Column:
    """Adjusted exponentially weighted mean.

    Values that are NULL, NaN or infinite take up a place but have no weight, and the mean is
    NULL there. Numerator and denominator are running sums in which row i weighs a^-i. The
    factor a^t that turns these into decaying weights is the same in both and cancels.
    """
    there = finite(value).isNotNull()
    if com == 0:
        return F.when(there, value)
    mean = F.try_divide(ewm_sum(value, com, window), ewm_sum(F.when(there, F.lit(1.0)), com, window))
    return F.when(there, mean)


def truncated_ema(
    value: Column, period: int, kind: str, window: WindowSpec, period_as_lookback: bool = False
) -> Column:
    """Exponential average over a fixed look-back, NULL until that many values are there.

    The oldest value stands for everything before it, so that the weights sum to 1. This
    form folds the values from the oldest on and works on any window; over blocks of bars, the
    layers of ``truncated_layers`` cost less. Each value is fetched with a lag, since a list of the
    frame would be built anew for every row.
    """
    s = Smoothing.of(period, kind)
    back = lookback_of(period, kind, period_as_lookback)
    # The start makes the oldest count 1 / weight times. A value that is missing leaves NULL.
    folded = F.lag(value, back).over(window) * F.lit((1 / s.weight - 1) / s.decay)
    for i in reversed(range(back + 1)):
        folded = folded * s.decay + (F.lag(value, i).over(window) if i else value)
    return folded * s.weight


def truncated_span(period: int, kind: str) -> int:
    """The same for ``truncated_layers``."""
    return int(2 * LARGEST_EXPONENT / -math.log(Smoothing.of(period, kind).decay))


def truncated_layers(
    column: str, period: int, kind: str, out: str, window: WindowSpec,
    period_as_lookback: bool = False,
) -> list[dict[str, Column]]:
    """The truncated average from running sums: what has left the look-back is taken off.

    That part weighs a thousandth, so no digits cancel. Values that are not finite are
    kept out of the sums and counted instead, since they would never leave them again.
    """
    s = Smoothing.of(period, kind)
    back = lookback_of(period, kind, period_as_lookback)
    x, weight = F.col(column), growing(-math.log(s.decay))
    upto = window.rowsBetween(Window.unboundedPreceding, 0)
    counts = {
        "values": x.isNotNull(), "nans": F.isnan(x),
        "ups": x == float("inf"), "downs": x == -float("inf"),
    }

    def name(part: str) -> str:
        return f"_{out}_{part}"

    def within(part: str) -> Column:
        before = F.lag(name(part), back + 1).over(window)
        return F.col(name(part)) - F.coalesce(before, F.lit(0))

    newer = F.col(name("sum")) - F.coalesce(F.col(name("left")), F.lit(0.0))
    mean = F.try_divide(newer, weight) * s.weight + F.col(name("oldest")) * (s.decay**back)
    nans, ups, downs = (F.col(name(f"{p}_in")) for p in ("nans", "ups", "downs"))
    return [
        {
            name("sum"): F.sum(finite(x) * weight).over(upto),
            **{name(p): F.count(F.when(c, 1)).over(upto) for p, c in counts.items()},
        },
        {
            name("left"): F.lag(name("sum"), back).over(window),
            name("oldest"): F.lag(column, back).over(window),
            **{name(f"{p}_in"): within(p) for p in counts},
        },
        {
            out: F.when(
                F.col(name("values_in")) == back + 1,
                F.when((nans > 0) | ((ups > 0) & (downs > 0)), float("nan"))
                .when(ups > 0, float("inf"))
                .when(downs > 0, -float("inf"))
                .otherwise(mean),
            )
        },
    ]


def lagged_ema(
    column: str, period: int, kind: str, window: WindowSpec, period_as_lookback: bool = False
) -> Column:
    """The truncated average as a plain sum of lagged columns, for short look-backs."""
    s = Smoothing.of(period, kind)
    back = lookback_of(period, kind, period_as_lookback)
    total = F.lag(column, back).over(window) * F.lit(s.decay**back)
    for i in range(back):
        past = F.lag(column, i).over(window) if i else F.col(column)
        total = total + past * F.lit(s.weight * s.decay**i)
    return total


def mean_tail_ema(
    column: str, mean_column: str, period: int, kind: str, window: WindowSpec,
    period_as_lookback: bool = False,
) -> Column:
    """As ``lagged_ema``, but the oldest term is the previous bar's mean (``mean_column``)."""
    s = Smoothing.of(period, kind)
    back = lookback_of(period, kind, period_as_lookback)
    total = F.lag(mean_column).over(window) * F.lit(s.decay**back)
    for i in range(back):
        past = F.lag(column, i).over(window) if i else F.col(column)
        total = total + past * F.lit(s.weight * s.decay**i)
    return total
