"""Zero, NULL and NaN prices, text tickers, bars finer than a day, and functions of one name."""

import math

import pytest
from pyspark.sql import functions as F

from conftest import series
from tickloom.catalog import QUERIES
from tickloom.operators import indicators as ind
from tickloom.operators import reports, strategy as st
from tickloom.operators import trades as tr
from tickloom.operators.series import drawdown
from tickloom.plans.layout import index_bars
from tickloom.plans.steps import compute


@pytest.fixture(scope="module")
def odd(spark):
    """Bars with zero, NULL and NaN prices in between."""
    bars = series(spark, [(1, i, 100 + math.sin(i)) for i in range(400)])
    n = F.col("bar_index")
    for column in ("open", "high", "low", "close"):
        bad = F.when(n == 50, 0.0).when(n == 51, None).when(n == 52, float("nan")).when(n == 300, 0.0)
        if column == "open":
            bad = bad.when(n == 120, 0.0)
        bars = bars.withColumn(column, bad.otherwise(F.col(column)))
    return bars


STEPS = {
    "rsi_ewm": lambda: [ind.rsi_ewm()],
    "rsi_wilder": lambda: [ind.rsi_wilder()],
    "tmf_signal": lambda: [ind.tmf_signal()],
    "adx": lambda: [ind.adx()],
    "macd": lambda: [ind.macd()],
    "medians": lambda: [ind.tmf_floor_medians()],
    "first_hit_exit": lambda: [tr.first_hit_exit()],
    "exit_from_signal_bar": lambda: [tr.exit_from_signal_bar(tr.WIDE)],
    "lagged_wins": lambda: [tr.lagged_wins()],
    "lagged_wins_incl": lambda: list(tr.lagged_wins_incl()),
    "change_split": lambda: [ind.change_split()],
}


@pytest.mark.parametrize("name", STEPS)
def test_no_step_raises(odd, name):
    assert len(compute(odd, *STEPS[name]()).collect()) == 400


def test_reports_do_not_raise(odd):
    for out in (reports.annualised_return(odd), reports.hold_return(odd), reports.best_per_month(odd), drawdown(odd)):
        out.collect()
    reports.with_index(odd, reports.index_series(odd)).collect()


def test_zero_entry_gives_infinity(spark):
    bars = series(spark, [(1, i, 0.0 if i == 1 else 10.0) for i in range(30)])
    got = compute(bars, tr.first_hit_exit()).where("bar_index = 1").first()
    assert got["entry_price"] == 0 and got["exit_gain_loss"] == math.inf and got["exit_reason"] == "gain"


def test_text_tickers_break_ties_by_name(spark):
    bars = series(spark, [(t, d, 10.0 + d) for t in ("BBB", "AAA") for d in range(5)], "ticker string, day int, close double")
    assert reports.best_per_month(bars).first()["ticker"] == "AAA"


def test_bars_within_a_day(spark):
    df = spark.range(500).select(
        F.lit("a").alias("ticker"), F.timestamp_seconds(F.col("id") * 3600).alias("date"), F.col("id").cast("double").alias("close")
    )
    got = index_bars(df).orderBy("date").collect()
    assert [r["bar_index"] for r in got] == list(range(1, 501))


def test_functions_of_one_name_are_told_apart():
    def times(factor):
        @st.reads(lambda: 0)
        def scaled(window, column):
            return F.col(column) * factor

        return scaled

    test = st.Backtest()
    first, second = (test.add_indicator(times(f), ["close"]) for f in (2, 3))
    assert first != second and first == test.add_indicator(times(2), ["close"])
    pulse = "pulse"
    one = test.add_strategy(pulse, allocation=lambda strength, total, count: 1 / count)
    two = test.add_strategy(pulse, allocation=lambda strength, total, count: 2 / count)
    assert one != two and len(test.strategies) == 2


def test_costs_see_the_trade_and_the_feed(bars):
    test = st.Backtest()
    test.add_data(bars)
    smooth = test.add_indicator(st.ewm_mean, ["close"], com=13)
    pulse = test.add_indicator(st.turns_flat, [test.add_indicator(st.change, [test.add_indicator(st.rolling_min, [smooth], count=20)])])
    test.add_strategy(pulse)
    test.add_broker(lambda ratio, trade: ratio - trade["days"] * 0.01)
    test.add_broker(lambda ratio: ratio * 0, feed="another feed")
    out = test.run().where("exit_gain_loss is not null")
    late = F.abs(F.col("net_ratio") - (F.col("exit_gain_loss") - F.datediff("exit_date", "entry_date") * 0.01)) > 1e-12
    assert out.count() > 0 and out.where(late).count() == 0


@pytest.mark.parametrize("name", ["scan_bars", "scan_glob", "latest_csv", "roundtrip_parquet", "roundtrip_csv"])
def test_queries_can_be_built_twice(spark, folder, name):
    first, second = (QUERIES[name](spark, folder) for _ in range(2))
    assert sorted(map(repr, first.collect())) == sorted(map(repr, second.collect()))
