"""The user-level interface: data, indicators, strategies and costs, put into one job."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from tickloom.functions import smoothing as sm
from tickloom.functions.numeric import ieee_div
from tickloom.operators import reports
from tickloom.operators.trades import ExitRule, first_hit_exit
from tickloom.plans.layout import rows
from tickloom.plans.steps import Step, compute, identity
from tickloom.session import use_checkpoints
from tickloom.streaming.steps import StepStream


def reads(back: Callable[..., int], ahead: Callable[..., int] = lambda **_: 0, span=lambda **_: None):
    """Declare how many bars an indicator function reads, from its parameters."""

    def mark(function):
        function.back, function.ahead, function.span = back, ahead, span
        return function

    return mark


# ---- indicator functions: (window, *columns, **params) -> Column -------------------------


@reads(lambda com: sm.ewm_reach(com), span=lambda com: sm.ewm_span(com))
def ewm_mean(window: WindowSpec, column: str, com: float) -> Column:
    return sm.ewm(F.col(column), com, window)


@reads(lambda count: count - 1)
def rolling_min(window: WindowSpec, column: str, count: int) -> Column:
    return F.min(column).over(rows(window, count))


@reads(lambda count: count - 1)
def rolling_mean(window: WindowSpec, column: str, count: int) -> Column:
    return F.avg(column).over(rows(window, count))


@reads(lambda: 1)
def change(window: WindowSpec, column: str) -> Column:
    return F.col(column) - F.lag(column).over(window)


@reads(lambda: 0)
def difference(window: WindowSpec, left: str, right: str) -> Column:
    return F.col(left) - F.col(right)


@reads(lambda: 0)
def quotient(window: WindowSpec, left: str, right: str) -> Column:
    return ieee_div(F.col(left), F.col(right))


@reads(lambda: 1)
def turns_flat(window: WindowSpec, column: str) -> Column:
    """1 when a falling value has stopped falling."""
    stopped = (F.col(column) == 0) & (F.lag(column).over(window) < 0)
    return F.when(stopped, 1).otherwise(0)


def fingerprint(function: Callable) -> str:
    """What a function does, as far as its code, defaults and enclosed values show it."""
    inner = inspect.unwrap(function)
    code = getattr(inner, "__code__", None)
    enclosed = [repr(c.cell_contents) for c in getattr(inner, "__closure__", None) or ()]
    parts = [inner.__module__, inner.__qualname__, str(inspect.signature(inner)), enclosed]
    if code is not None:
        constants = [c.co_code if inspect.iscode(c) else c for c in code.co_consts]
        parts += [code.co_code.hex(), repr(constants), code.co_names]
    return repr(parts)


def takes_trade(cost: Callable[..., Column]) -> bool:
    """Whether a cost function asks for the trade: a second argument without a default."""
    second = list(inspect.signature(cost).parameters.values())[1:2]
    return bool(second) and second[0].default is inspect.Parameter.empty


def equal_share(strength: Column, total: Column, count: Column) -> Column:
    return 1 / count


def share_of_strength(strength: Column, total: Column, count: Column) -> Column:
    """Part of the day's strength, so that the shares of a day add up to 1."""
    return F.try_divide(strength, total)


def allocate(
    signals: DataFrame, share: Callable[[Column, Column, Column], Column], *keys: str
) -> DataFrame:
    """Split each day's capital (of each of ``keys``) over its signals by their ``strength``.

    Days are summed up first and joined back, so no task holds all signals of a day. The
    signals, few against the bars, are checkpointed, so that this does not find them twice.
    """
    use_checkpoints(signals.sparkSession)
    signals = signals.checkpoint()
    day = [*keys, "date"]
    days = signals.groupBy(*day).agg(
        F.sum("strength").alias("_total"), F.count("strength").alias("_count")
    )
    return (
        signals.join(days, day)
        .withColumn("allocation", share(F.col("strength"), F.col("_total"), F.col("_count")))
        .drop("_total", "_count")
    )


_TRADE = ["ticker", "date", "entry_date", "entry_price", "exit_date", "exit_price", "exit_reason"]


class Backtest:
    """Collects bars, indicators, strategies and costs; nothing runs until the end.

    Every call gives a uid made of the source columns, the function (its code and enclosed values,
    not its name alone) and its parameters. Asking for the same thing again gives the same uid and adds no work.
    """

    def __init__(self, exit_rule: ExitRule = ExitRule(), capital: float | None = None):
        """``capital`` is what a strategy has to spend on each day; only costs that depend on a trade's size need it."""
        self.exit_rule, self.capital = exit_rule, capital
        self.feeds: dict[str, DataFrame] = {}
        self.steps: dict[str, Step] = {}
        self.strategies: dict[str, tuple[str, str | None, Callable]] = {}
        self.costs: list[tuple[Callable[..., Column], str | None]] = []

    def add_data(self, indexed: DataFrame, name: str = "bars") -> str:
        self.feeds[name] = indexed
        return name

    def add_indicator(self, function: Callable[..., Column], inputs: Sequence[str], **params) -> str:
        """``inputs`` are bar columns or uids of other indicators."""
        uid = f"{function.__name__.strip('<>')}_{identity(inputs, fingerprint(function) + '|' + ','.join(inputs), params)}"
        if uid not in self.steps:
            needs = tuple(self.steps[i] for i in inputs if i in self.steps)
            self.steps[uid] = Step(
                uid,
                lambda w: [{uid: function(w, *inputs, **params)}],
                needs,
                back=function.back(**params),
                ahead=function.ahead(**params),
                span=function.span(**params),
            )
        return uid

    def add_strategy(
        self, pulse: str, strength: str | None = None, allocation: Callable = equal_share
    ) -> str:
        """``pulse`` is the uid of a 0/1 indicator; ``strength`` another uid, or 1 throughout."""
        uid = f"strategy_{identity([pulse, strength or ''], fingerprint(allocation), {})}"
        self.strategies[uid] = (pulse, strength, allocation)
        return uid

    def add_broker(self, cost: Callable[..., Column], feed: str | None = None) -> None:
        """``cost`` turns a trade's price ratio into the ratio after costs, on one feed or all.

        A function of two arguments also gets the trade: its columns by name (ticker, date,
        entry_date, entry_price, exit_date, exit_price, exit_reason, strength, days held, and capital: its
        share of the day's capital, where the backtest has one).
        """
        self.costs.append((cost, feed))

    def frame(self, uids: Sequence[str], feed: str = "bars") -> DataFrame:
        """Bars with the columns of the given indicators."""
        return compute(self.feeds[feed], *[self.steps[u] for u in uids])

    def _steps(self, strategies: Sequence[str]) -> list[Step]:
        """What the signals of some strategies and their outcomes are computed with."""
        wanted = {u: self.steps[u] for uid in strategies for u in self.strategies[uid][:2] if u}
        return [*wanted.values(), first_hit_exit(self.exit_rule)]

    def signals(self, strategies: Sequence[str], feed: str = "bars") -> DataFrame:
        """One row per signal and strategy with its outcome and net ratio; one pass over the bars.

        Shares of the capital are not known here, so costs that ask for the capital give null.
        """
        if not strategies:
            raise ValueError("add a strategy first")
        return self._net(self._signals(compute(self.feeds[feed], *self._steps(strategies)), strategies), feed)

    def _signals(self, out: DataFrame, strategies: Sequence[str]) -> DataFrame:
        """One row per signal and strategy with its outcome, before costs."""
        given = [
            F.when(
                F.col(pulse) == 1,
                F.struct(
                    F.lit(uid).alias("strategy"),
                    (F.abs(F.col(strength)) if strength else F.lit(1.0)).cast("double").alias("strength"),
                ),
            )
            for uid, (pulse, strength, _) in ((uid, self.strategies[uid]) for uid in strategies)
        ]
        out = out.withColumn("_given", F.explode(F.filter(F.array(*given), lambda g: g.isNotNull())))
        return out.select(*_TRADE, "exit_gain_loss", "_given.strength", "_given.strategy")

    def _net(self, trades: DataFrame, feed: str) -> DataFrame:
        """Trades with the ratio after all costs of a feed."""
        trade = {c: F.col(c) for c in (*_TRADE, "strength")}
        trade["days"] = F.datediff("exit_date", "entry_date")
        own = F.col("allocation") if "allocation" in trades.columns else F.lit(None).cast("double")
        trade["capital"] = own * F.lit(self.capital).cast("double")
        net = F.col("exit_gain_loss")
        for cost, only in self.costs:
            if only in (None, feed):
                more = (trade,) if takes_trade(cost) else ()
                net = cost(net, *more)
        return trades.withColumn("net_ratio", net)

    def trades(self, strategy: str, feed: str = "bars") -> DataFrame:
        """One row per signal with its outcome, net ratio and share of the day's capital."""
        signals = self._signals(compute(self.feeds[feed], *self._steps([strategy])), [strategy])
        return self._net(allocate(signals, self.strategies[strategy][2]), feed).drop("strategy")

    def run(self, feed: str = "bars") -> DataFrame:
        """The trades of all strategies, found in one pass over the bars."""
        if not self.strategies:
            raise ValueError("add a strategy first")
        uids = list(self.strategies)
        return self._shared(self._signals(compute(self.feeds[feed], *self._steps(uids)), uids), feed)

    def stream(self, path: str, feed: str = "bars") -> StepStream:
        """The same strategies on a stream: its results are the signals with their outcomes, as these become known."""
        if not self.strategies:
            raise ValueError("add a strategy first")
        uids = list(self.strategies)
        return StepStream(path, self._steps(uids), lambda rows: self._signals(rows, uids))

    def run_stream(self, bars: DataFrame, path: str, checkpoint: str, feed: str = "bars") -> DataFrame:
        """Take in a stream of closed bars to its end and return the trades, as ``run`` does for stored bars."""
        stream = self.stream(path, feed)
        stream.run(bars, checkpoint, finish=True)
        return self._shared(stream.results(bars.sparkSession), feed)

    def _shared(self, signals: DataFrame, feed: str) -> DataFrame:
        """Signals with their share of the day's capital, and the ratio after costs."""

        def share(strength: Column, total: Column, count: Column) -> Column:
            own = F.lit(None).cast("double")
            for uid, (_, _, allocation) in self.strategies.items():
                own = F.when(F.col("strategy") == uid, allocation(strength, total, count)).otherwise(own)
            return own

        return self._net(allocate(signals, share, "strategy"), feed)

    def performance(self, trades: DataFrame) -> DataFrame:
        """Yearly figures of a run, after costs."""
        years = reports.trade_year(trades, "net_ratio")
        return reports.year_profile(years)
