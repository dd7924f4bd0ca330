"""Outcome of a trade opened after each bar: exits, slip, costs, and past success."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce
from itertools import pairwise
from operator import add, or_

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

from tickloom.functions.numeric import ieee_div
from tickloom.functions.sliding import counted
from tickloom.operators.indicators import tmf_floor_medians, tmf_signal, tmf_signal_incl
from tickloom.plans.steps import Step

# Commission as a share of the trade, and the yearly funding rate.
COMMISSION = 0.002
FUNDING_RATE = 0.05
# Fee of a broker by the size of a trade, for buying and for selling.
FEE_RATE, FEE_ABOVE, SMALLEST_FEE = 0.0005, 10_000.0, 5.0


@dataclass(frozen=True)
class ExitRule:
    """Longest holding in bars, and the price ratios that end a trade earlier."""

    hold: int = 10
    gain: float = 1.05
    loss: float = 0.95


WIDE = ExitRule(20, 1.1, 0.9)
NARROW = ExitRule(10, 1.05, 0.95)


def typical_price() -> Column:
    return (F.col("open") + F.col("high") + F.col("low") + F.col("close")) / 4


def path(name: str, value: Column, count: int, w: WindowSpec) -> dict[str, Column]:
    """A value on the current and the next bars, each a column of its own; rules that look ahead share them."""
    return {f"_{name}_at_{k}": F.lead(value, k).over(w) if k else value for k in range(count)}


def exit_place(closes: list[Column], entry: Column, rule: ExitRule) -> Column:
    """Place of the first hit among the closes that are there, at most that to hold to; NULL if they end before."""
    place = F.lit(None).cast("int")
    for close in reversed(closes):
        change = F.try_divide(close, entry)
        hit = (change > rule.gain) | (change < rule.loss)
        # a missing close has no place of its own
        place = F.when(hit, 0).otherwise(place + close.isNotNull().cast("int"))
    there = reduce(add, [close.isNotNull().cast("int") for close in closes])
    # over an entry price of zero any change is infinite or NaN, which counts as a gain
    place = F.when(entry == 0, F.when(there > 0, 0)).otherwise(place)
    return F.least(place, F.when(there > rule.hold, rule.hold))


def nth_present(values: list[Column], place: Column) -> Column:
    """The value at a place among those that are there; lists are put together only where a gap moves a value up."""
    moved = reduce(or_, [a.isNull() & b.isNotNull() for a, b in pairwise(values)])
    none = F.array().cast("array<double>")
    there = F.flatten(F.array(*[F.when(x.isNotNull(), F.array(x)).otherwise(none) for x in values]))
    return F.when(moved, F.get(there, place)).otherwise(F.get(F.array(*values), place))


def first_hit_exit(rule: ExitRule = ExitRule()) -> Step:
    """Enter at the next bar's typical price; leave one bar after the first exit condition.

    Bars t+1 .. t+hold+2 are looked at, and the outcome is NULL when not all of them exist.
    """
    bars = rule.hold + 2
    entry, found = F.col("entry_price"), F.col("_exit")

    def pieces(w):
        def ahead(name: str, value: Column, count: int) -> dict[str, Column]:
            return {f"_{name}_{k}": F.lead(value, k + 1).over(w) for k in range(count)}

        def leave(at: int, reason: str) -> Column:
            """Out one bar after the bar ``at`` of the path, which starts with the entry's."""
            return F.struct(
                F.lit(at + 1).cast("bigint").alias("point"), F.col(f"_x_{at + 1}").alias("price"),
                F.col(f"_d_{at + 1}").alias("date"), F.lit(reason).alias("reason"),
            )

        whole, start = F.col("_whole"), F.col("_x_0")
        outcome = F.when(whole.isNull(), None)
        for at in range(rule.hold + 1):
            ratio = ieee_div(F.col(f"_c_{at}"), start)
            outcome = outcome.when(ratio > rule.gain, leave(at, "gain")).when(ratio < rule.loss, leave(at, "loss"))
        return [
            {
                **ahead("c", F.col("close"), rule.hold + 1), **ahead("x", typical_price(), bars),
                **ahead("d", F.col("date"), bars), "_whole": F.lead(F.lit(1), bars).over(w),
            },
            {
                "_exit": outcome.otherwise(leave(rule.hold, "period")),
                "entry_price": F.when(whole.isNotNull(), start),
                "entry_date": F.when(whole.isNotNull(), F.col("_d_0")),
            },
            {
                "exit_point": found["point"], "exit_price": found["price"], "exit_date": found["date"],
                "exit_reason": found["reason"], "exit_gain_loss": ieee_div(found["price"], entry),
            },
        ]

    return Step(f"first_hit_exit:{rule}", pieces, ahead=bars)


def entry_columns(w: WindowSpec) -> dict[str, Column]:
    return {"next_entry_price": F.lead(typical_price()).over(w), "buy_price": F.lead("open").over(w)}


def next_entry() -> Step:
    """The next bar's typical price and open."""
    return Step("next_entry", lambda w: [entry_columns(w)], ahead=1)


def exit_from_signal_bar(rule: ExitRule, tag: str = "") -> Step:
    """The variant that watches closes from the signal bar on, with slip at the middle price.

    ``exit_index`` counts bars from the signal bar; NULL where the series ends too early.
    """
    entry = F.col("next_entry_price")
    index, slip, ratio = f"exit_index{tag}", f"exit_slip_price{tag}", f"gain_loss_ratio{tag}"

    def pieces(w):
        middle = (F.col("high") + F.col("low")) / 2
        closes = path("close", F.col("close"), rule.hold + 2, w)
        middles = path("middle", middle, rule.hold + 4, w)
        # without an entry price only the end of the holding period counts
        place = exit_place([F.col(c) for c in closes], entry, rule) + 2
        return [
            {"slip_price": middle, **entry_columns(w), **closes, **middles},
            # in one layer, so that the paths are carried no further
            {index: place.cast("bigint"), slip: nth_present([F.col(m) for m in middles], place)},
            {ratio: net_ratio(ieee_div(F.col(slip), entry))},
        ]

    return Step(f"exit_from_signal_bar:{rule}:{tag}", pieces, ahead=rule.hold + 3)


def past_success(
    ratio: str, signal: str, threshold: float, first: int, last: int, tag: str,
    needs: tuple[Step, ...],
) -> Step:
    """Won and lost signals among the bars ``first`` .. ``last`` before the current one."""
    won = (F.col(ratio) > threshold) & (F.col(signal) == 1)
    lost = (F.col(ratio) <= threshold) & (F.col(signal) == 1)
    success, fail = f"previous_exit_success{tag}", f"previous_exit_fail{tag}"

    def pieces(w):
        return [
            *counted({success: won, fail: lost}, first, last, w, "past"),
            {f"previous_exit_result_ratio{tag}": ieee_div(F.col(success).cast("double"), F.col(fail) + 1)},
        ]

    return Step(f"past_success:{ratio}:{threshold}:{first}:{last}:{tag}", pieces, needs, back=first + 1)


def lagged_wins(rule: ExitRule = ExitRule()) -> Step:
    """Success over the year that ended 30 bars ago."""
    return past_success(
        "exit_gain_loss", "signal", 1.02, 52 * 5 + 29, 30, "", (first_hit_exit(rule), tmf_signal())
    )


def lagged_wins_incl() -> tuple[Step, Step]:
    """The same for both exit rules of the signal-bar variant, each with its own lag."""
    signal = tmf_signal_incl()
    return (
        past_success(
            "gain_loss_ratio", "signal_incl", 1.02, 290, 30, "_incl",
            (exit_from_signal_bar(WIDE), signal),
        ),
        past_success(
            "gain_loss_ratio2", "signal_incl", 1.01, 280, 20, "_incl2",
            (exit_from_signal_bar(NARROW, "2"), signal),
        ),
    )


def net_ratio(ratio: Column, commission: float = COMMISSION) -> Column:
    """A price ratio after commission."""
    return ratio - F.lit(commission)


def fee_by_size(
    rate: float = FEE_RATE, above: float = FEE_ABOVE, smallest: float = SMALLEST_FEE
) -> Callable[[Column, Mapping[str, Column]], Column]:
    """A cost for ``Backtest.add_broker``: a share of trades over ``above``, a fixed fee for smaller ones, paid twice.

    Needs the capital of the trade, so give the backtest a capital. A trade without capital has no net ratio.
    """

    def fee_of_trade(ratio: Column, trade: Mapping[str, Column]) -> Column:
        capital = trade["capital"]
        return ratio - 2 * F.when(capital > above, F.lit(rate)).otherwise(F.try_divide(F.lit(smallest), capital))

    return fee_of_trade


def funding_factor(days: Column, rate: float = FUNDING_RATE) -> Column:
    """Growth of borrowed money held overnight for a number of days."""
    return F.pow(F.lit(1 + rate / 365), days.cast("double"))


def signal_strength() -> Step:
    """Size of the last fall of the floor against the median fall."""
    fall = F.abs(F.col("_last_fall"))
    return Step(
        "signal_strength",
        lambda w: [
            {"_last_fall": F.lag("tmf_26w_min_dd").over(w)},
            {
                "strength": F.when(
                    F.col("signal") == 1, ieee_div(fall, F.abs(F.col("tmf_26w_min_dd_qtl_50")))
                )
            },
        ],
        (tmf_signal(), tmf_floor_medians()),
        back=1,
    )
