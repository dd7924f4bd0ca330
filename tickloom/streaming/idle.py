"""Instruments that fall silent on a stream of bars.

Each instrument's state is one row (its last bar, how many bars there were and their lowest and highest close), kept by
the state store. A timer on event time closes an instrument once the watermark has passed its last bar by the given
days; the row is reported and the state ends, so that memory follows the instruments that are alive, not all there ever were. A bar
after such a gap starts anew, also where both come in one micro-batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tickloom.streaming.bars import run_to_parquet

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_DAY = 86_400_000
_ROW = ["ticker", "first", "last", "n_bars", "lowest", "highest"]


class _Silence(StatefulProcessor):
    """One row of state per instrument; times in milliseconds."""

    def __init__(self, days: int) -> None:
        self.gap = days * _DAY

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "first long, last long, n_bars long, lowest double, highest double")

    def _expiry(self, last: int) -> int:
        return last + self.gap + 1

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        bars = pd.concat(list(rows)).sort_values("moment")
        moments = bars["moment"].to_numpy("int64")
        closes = bars["close"].to_numpy("float64")
        state = tuple(self.seen.get()) if self.seen.exists() else None
        if state is not None:
            self.handle.deleteTimer(self._expiry(state[1]))
        closed = []
        for moment, close in zip(moments.tolist(), closes.tolist()):
            if state is not None and moment - state[1] > self.gap:
                closed.append((key[0], *state))
                state = None
            if state is None:
                state = (moment, moment, 0, close, close)
            first, last, count, lowest, highest = state
            state = (min(first, moment), max(last, moment), count + 1, min(lowest, close), max(highest, close))
        self.seen.update(state)
        self.handle.registerTimer(self._expiry(state[1]))
        if closed:
            yield pd.DataFrame(closed, columns=_ROW)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.seen.exists():
            state = tuple(self.seen.get())
            self.seen.clear()
            yield pd.DataFrame([(key[0], *state)], columns=_ROW)

    def close(self) -> None: ...


@contextmanager
def _rocks(spark: SparkSession):
    """The state store that timers need, set for the queries started inside only."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def idle_stream(bars: DataFrame, days: int, watermark: str) -> DataFrame:
    """One row per instrument and stretch of bars (ticker, date, close) that is followed by more than ``days`` days of silence.

    Returns ticker, first_date, last_date, n_bars, lowest and highest close. Bars of an instrument come in time order, those
    of different instruments may be apart by the watermark. The last stretch is reported once the watermark has passed it.
    """
    key = bars.schema["ticker"].dataType.simpleString()
    timed = bars.select("ticker", "close", F.col("date").cast("timestamp").alias("at")).withWatermark("at", watermark)
    timed = timed.withColumn("moment", F.unix_millis("at"))
    found = timed.groupBy("ticker").transformWithStateInPandas(
        _Silence(days),
        f"ticker {key}, first long, last long, n_bars long, lowest double, highest double",
        "append",
        "EventTime",
    )
    dates = [F.timestamp_millis(c).cast("date").alias(f"{c}_date") for c in ("first", "last")]
    return found.select("ticker", *dates, "n_bars", "lowest", "highest")


def run_idle(bars: DataFrame, days: int, watermark: str, path: str, checkpoint: str) -> DataFrame:
    """Take in a stream of bars to its end and read what was closed."""
    spark = bars.sparkSession
    stream = idle_stream(bars, days, watermark)
    with _rocks(spark):
        run_to_parquet(stream, path, checkpoint)
    return spark.read.schema(stream.schema).option("recursiveFileLookup", True).parquet(path)


def open_instruments(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The state of a query of ``run_idle`` as a table: the instruments that are still open."""
    with _rocks(spark):
        state = spark.read.format("statestore").option("stateVarName", "seen").load(checkpoint)
    value = [F.col(f"value.{c}").alias(c) for c in _ROW[1:]]
    return state.select(F.col("key.ticker").alias("ticker"), *value)
