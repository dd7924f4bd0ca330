"""Indicators on a stream of closed bars, with the recursion kept as state per instrument.

Feed closed bars in time order, as ``tumbling_bars`` gives them, of any width. Two bars of an instrument
with the same time in a micro-batch are an error. A bar that is not later than those of earlier micro-batches
is left out and counted in ``late``. ``files_per_trigger`` of the source bounds the bars
one call sees; history is better computed with the batch operators.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tickloom.operators.indicators import HALF_YEAR_BARS, SMOOTH, ZERO_RANGE

INF, NAN = float("inf"), float("nan")


def _divide(num: float, den: float) -> float:
    if den != 0:
        return num / den
    return NAN if num == 0 else INF if num > 0 else -INF


class _Ewm:
    """Numerator and denominator of an adjusted mean."""

    def __init__(self, com: float, num: float = 0.0, den: float = 0.0):
        self.keep, self.num, self.den = com / (1 + com), num, den

    def add(self, value: float) -> float:
        """The mean with this value; one that is not finite takes up a place only."""
        there = math.isfinite(value)
        self.num = self.num * self.keep + (value if there else 0.0)
        self.den = self.den * self.keep + there
        return self.num / self.den if there else NAN

    def state(self) -> tuple[float, float]:
        return self.num, self.den


def _money_flow(bar, last_close: float | None) -> float:
    top = bar.high if last_close is None else max(bar.high, last_close)
    bottom = bar.low if last_close is None else min(bar.low, last_close)
    return (2 * bar.close - top - bottom) / (top - bottom + ZERO_RANGE) * bar.volume


def _new_bars(batches: Iterable[pd.DataFrame], last: int) -> tuple[Iterator, int]:
    """The bars of one instrument in a micro-batch, in time order, and how many came late."""
    frame = pd.concat(list(batches))
    frame["moment"] = pd.to_datetime(frame["date"]).astype("datetime64[us]").astype("int64")
    new = frame[frame["moment"] > last].sort_values("moment")
    if new["moment"].duplicated().any():
        raise ValueError(f"bars must be unique by (ticker, date): {new['ticker'].iloc[0]}")
    return new.itertuples(index=False), len(frame) - len(new)


class _Lowest:
    """The lowest of the last ``count`` values: only those that can still become the lowest are kept."""

    def __init__(self, count: int, recent: list[float]):
        self.count, self.at = count, 0
        self.values, self.recent = deque(), deque(maxlen=count)
        for value in recent:
            self.add(value)

    def add(self, value: float) -> float:
        self.recent.append(value)
        while self.values and not self.values[-1][1] < value:
            self.values.pop()
        self.values.append((self.at, value))
        if self.values[0][0] <= self.at - self.count:
            self.values.popleft()
        self.at += 1
        return self.values[0][1]


def _stateful(bars: DataFrame, step: Callable, output: str, state: str) -> DataFrame:
    return bars.groupBy("ticker").applyInPandasWithState(
        step, output, state, "append", GroupStateTimeout.NoTimeout
    )


def ewm_stream(bars: DataFrame, com: float = SMOOTH - 1) -> DataFrame:
    """Exact smoothed close, money flow and RSI per closed bar, as in the batch steps."""
    key = bars.schema["ticker"].dataType.simpleString()
    moment = bars.schema["date"].dataType.simpleString()
    names = ("close", "ad", "volume", "gain", "loss")

    def step(ticker: tuple, batches: Iterable[pd.DataFrame], state: GroupState):
        if state.exists:
            last, late, last_close, *kept = state.get
        else:
            last, late, last_close, kept = -(2**62), 0, None, [0.0] * (2 * len(names))
        means = {n: _Ewm(com, kept[2 * i], kept[2 * i + 1]) for i, n in enumerate(names)}
        found = []
        new, missed = _new_bars(batches, last)
        late += missed
        for bar in new:
            change = _divide(bar.close, bar.open) - 1
            ema_close = means["close"].add(bar.close)
            ema_ad = means["ad"].add(_money_flow(bar, last_close))
            ema_volume = means["volume"].add(bar.volume)
            gain = means["gain"].add(change if change > 0 else 0.0)
            loss = means["loss"].add(change if change <= 0 else 0.0)
            rsi = 100 - _divide(100.0, 1 + _divide(gain, loss))
            found.append((ticker[0], bar.date, ema_close, _divide(ema_ad, ema_volume), rsi, late))
            last, last_close = int(bar.moment), float(bar.close)
        state.update((last, late, last_close, *[v for n in names for v in means[n].state()]))
        yield pd.DataFrame(found, columns=["ticker", "date", "ema_close", "tmf_w", "rsi_ewm", "late"])

    kept = ", ".join(f"{n}_num double, {n}_den double" for n in names)
    return _stateful(
        bars, step,
        f"ticker {key}, date {moment}, ema_close double, tmf_w double, rsi_ewm double, late long",
        f"last long, late long, last_close double, {kept}",
    )


def signal_stream(
    bars: DataFrame, com: float = SMOOTH - 1, floor_bars: int = HALF_YEAR_BARS
) -> DataFrame:
    """The money-flow entry signal per closed bar; state holds the last ``floor_bars`` values."""
    key = bars.schema["ticker"].dataType.simpleString()
    moment = bars.schema["date"].dataType.simpleString()

    def step(ticker: tuple, batches: Iterable[pd.DataFrame], state: GroupState):
        if state.exists:
            last, late, last_close, *kept, last_min, last_dd, recent = state.get
        else:
            last, late, last_close, kept = -(2**62), 0, None, [0.0] * 4
            last_min, last_dd, recent = None, None, []
        ad, volume = _Ewm(com, kept[0], kept[1]), _Ewm(com, kept[2], kept[3])
        window = _Lowest(floor_bars, recent)
        found = []
        new, missed = _new_bars(batches, last)
        late += missed
        for bar in new:
            ema_ad = ad.add(_money_flow(bar, last_close))
            tmf = _divide(ema_ad, volume.add(bar.volume))
            low = window.add(tmf)
            dd = None if last_min is None else low - last_min
            signal = int(dd == 0 and last_dd is not None and last_dd < 0)
            found.append((ticker[0], bar.date, tmf, low, dd, signal, late))
            last, last_close, last_min, last_dd = int(bar.moment), float(bar.close), low, dd
        state.update(
            (last, late, last_close, *ad.state(), *volume.state(), last_min, last_dd, list(window.recent))
        )
        out = pd.DataFrame(
            found,
            columns=["ticker", "date", "tmf_w", "tmf_26w_min", "tmf_26w_min_dd", "signal", "late"],
        )
        out["tmf_26w_min_dd"] = out["tmf_26w_min_dd"].astype("float64")
        yield out

    return _stateful(
        bars, step,
        f"ticker {key}, date {moment}, tmf_w double, tmf_26w_min double, tmf_26w_min_dd double, signal int, late long",
        "last long, late long, last_close double, ad_num double, ad_den double, "
        "volume_num double, volume_den double, last_min double, last_dd double, "
        "recent array<double>",
    )
