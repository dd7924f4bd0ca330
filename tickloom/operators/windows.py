"""Rolling columns over the block window, and the steps that use them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tickloom.plans.layout import rows
from tickloom.plans.steps import Quantile, Step

YEAR_BARS = 5 * 52
YEAR_FRAME = YEAR_BARS + 1


def full_window(value: Column, count: int, how, window: WindowSpec) -> Column:
    """An aggregate over ``count`` bars, NULL until all of them have a value."""
    frame = rows(window, count)
    return F.when(F.count(value).over(frame) == count, how(value).over(frame))


def simple(name: str, column: str, build, back: int, ahead: int = 0, needs: tuple[Step, ...] = ()) -> Step:
    """A step of one column; ``build(window)`` gives the expression."""
    return Step(name, lambda w: [{column: build(w)}], needs, back, ahead)


def rolling(column: str, count: int, how, out: str, needs: tuple[Step, ...] = ()) -> Step:
    """``how`` (an aggregate function) of ``column`` over the last ``count`` bars."""
    return simple(out, out, lambda w: how(column).over(rows(w, count)), count - 1, needs=needs)


def rolling_full(column: str, count: int, how, out: str, needs: tuple[Step, ...] = ()) -> Step:
    return simple(
        out, out, lambda w: full_window(F.col(column), count, how, w), count - 1, needs=needs
    )


def rolling_quantiles(name: str, *quantiles: Quantile, needs: tuple[Step, ...] = ()) -> Step:
    """Quantiles of sliding frames; frames of any length and all fractions share one pass."""
    return Step(name, lambda w: [], needs, max(q.bars for q in quantiles) - 1, quantiles=quantiles)


def lag_lead(column: str, by: int = 1) -> Step:
    return Step(
        f"lag_lead_{column}_{by}",
        lambda w: [
            {
                f"{column}_lag": F.lag(column, by).over(w),
                f"{column}_lead": F.lead(column, by).over(w),
            }
        ],
        back=by,
        ahead=by,
    )


def history_lists(column: str, count: int, out: str) -> Step:
    """The values of the ``count`` bars before the current one, oldest first."""
    return simple(
        out, out, lambda w: F.collect_list(column).over(w.rowsBetween(-count, -1)), count
    )


def calendar_rolling(
    bars: DataFrame, frames: Mapping[str, tuple], key: str = "ticker", time: str = "date",
    block_days: int = 1024,
) -> DataFrame:
    """Aggregates over the last calendar days; ``frames`` maps a name to (how, column, days).

    Blocks are runs of days here, so no bar numbers are needed: a bar goes into its own
    run and, if a later run looks back at it, into that one as well.
    """
    longest = max(days for _, _, days in frames.values())
    day = F.unix_date(F.col(time)).cast("bigint")
    own = F.floor(day / block_days)
    last = F.floor((day + longest - 1) / block_days)
    w = Window.partitionBy(key, "_run").orderBy("_day")
    return (
        bars.withColumn("_day", day)
        .withColumn("_run", F.explode(F.sequence(own, last)))
        .withColumns(
            {
                out: how(column).over(w.rangeBetween(-(days - 1), 0))
                for out, (how, column, days) in frames.items()
            }
        )
        .where(F.floor(F.col("_day") / block_days) == F.col("_run"))
        .drop("_day", "_run")
    )


def expanding_list(rows_: DataFrame, keys: list[str], order: str, column: str, out: str) -> DataFrame:
    """Values from the start of the group up to the current row.

    The lists grow with the group, so the group must be bounded: give keys such as
    (ticker, month), not an instrument with an open end.
    """
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows_.withColumn(out, F.collect_list(column).over(w))
