"""Averages against pandas, and edge cases of the indicators."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import series
from tickloom.functions.numeric import ieee_div, nan_to
from tickloom.functions.smoothing import ewm_reach, ewm_span
from tickloom.operators import indicators as ind
from tickloom.operators import trades as tr
from tickloom.plans.layout import BLOCK_ROWS
from tickloom.plans.steps import Step, compute

KEY = ["ticker", "bar_index"]


def walk(count, seed=1):
    return np.random.default_rng(seed).normal(0, 1, count).cumsum() + 100


@pytest.mark.parametrize("com", [0, 0.5, 4, 13, 25, 200])
def test_ewm_is_exact(spark, com):
    values = walk(3000)
    bars = series(spark, [(1, i, float(x)) for i, x in enumerate(values)])
    out = compute(bars, ind.ewm("close", com, "e"), block=500).orderBy("bar_index").toPandas()
    want = pd.Series(values).ewm(com=com).mean() if com else pd.Series(values)
    np.testing.assert_allclose(out["e"], want, rtol=1e-12)


def test_ewm_with_nulls(spark):
    values = walk(400)
    bars = series(spark, [(1, i, float(x)) for i, x in enumerate(values)])
    gaps = Step("gaps", lambda w: [{"x": F.when(F.col("bar_index") % 7 != 0, F.col("close"))}])
    out = compute(bars, ind.ewm("x", 13, "e", (gaps,))).orderBy("bar_index").toPandas()
    x = pd.Series(values).where(np.arange(1, 401) % 7 != 0)
    want = x.ewm(com=13, ignore_na=False).mean().where(x.notna())
    np.testing.assert_allclose(out["e"], want, rtol=1e-12)


def test_truncated_forms_agree(spark):
    """Running sums against folded lists, with gaps and values that are not finite."""
    bars = series(spark, [(1, i, float(x)) for i, x in enumerate(walk(1200))])
    n = F.col("bar_index")
    odd = (
        F.when(n == 300, None).when(n == 450, float("nan")).when(n.isin(600, 700), float("inf"))
        .when(n == 705, -float("inf")).when(n == 800, -float("inf")).otherwise(F.col("close"))
    )
    bars = bars.withColumn("x", odd)
    steps = ind.ema_truncated("x", 14, "wilder", "sums"), ind.ema_truncated_fold("x", 14, "wilder", "lists")
    for block in (4096, 130):
        out = compute(bars, *steps, block=block).orderBy("bar_index").select("sums", "lists")
        assert out.where("(sums IS NULL) <> (lists IS NULL)").count() == 0
        got = out.toPandas()
        np.testing.assert_allclose(got["sums"], got["lists"], rtol=1e-12)
        assert got["sums"].notna().sum() > 700 and np.isinf(got["sums"]).any()


def test_reach_and_span():
    assert ewm_reach(13) > 600 and ewm_span(13) > 4096 + ewm_reach(13)
    assert all(ewm_span(com) > 10 * ewm_reach(com) for com in (0.1, 1, 4, 13, 199, 1000))


@pytest.mark.parametrize("scale", [1e-6, 1.0, 1e12])
def test_ewm_on_long_series(spark, scale):
    """Neither size of values, nor blocks, nor other steps change a result; NaN has no weight."""
    x = walk(10_000, 5) * scale
    x[[70, 5000, 5001]] = math.nan
    bars = series(spark, [(1, i, float(v)) for i, v in enumerate(x)])
    steps = [ind.ewm("close", com, f"e{com}") for com in (1, 4, 199)]
    far = Step("far", lambda w: [{"far": F.lag("close", 700).over(w)}], back=700)
    for block, more in ((128, ()), (1024, ()), (4096, (far,)), (None, ())):
        out = compute(bars, *steps, *more, block=block).orderBy("bar_index").toPandas()
        for com in (1, 4, 199):
            want = pd.Series(x).ewm(com=com).mean().where(~np.isnan(x))
            np.testing.assert_allclose(out[f"e{com}"], want, rtol=1e-9)
    if scale == 1:
        out = compute(bars, ind.ewm("close", 1000, "e")).orderBy("bar_index").toPandas()
        np.testing.assert_allclose(out["e"], pd.Series(x).ewm(com=1000).mean().where(~np.isnan(x)), rtol=1e-9)


def test_truncated_on_long_series(spark):
    x = walk(8000, 6) * 1e7
    bars = series(spark, [(1, i, float(v)) for i, v in enumerate(x)])
    steps = ind.ema_truncated("close", 9, "standard", "sums"), ind.ema_truncated_fold("close", 9, "standard", "lists")
    got = compute(bars, *steps).orderBy("bar_index").toPandas()
    np.testing.assert_allclose(got["sums"], got["lists"], rtol=1e-9)


@pytest.mark.parametrize("com", [1, 13, 199, 1000])
def test_copies_do_not_grow_with_the_period(com):
    step = ind.ewm("close", com, "e")
    block = min(max(BLOCK_ROWS, 2 * step.back), step.span)
    assert (block + step.back) / block <= 1.5


def test_rsi_wilder_is_the_recursion(spark):
    values = walk(900, 3)
    bars = series(spark, [(1, i, float(x)) for i, x in enumerate(values)])
    out = compute(bars, ind.rsi_wilder(), block=100).orderBy("bar_index").toPandas()["rsi_wilder"]
    change = np.diff(values)
    up, down = np.maximum(change, 0), np.maximum(-change, 0)
    g, l = up[:14].mean(), down[:14].mean()
    want = [math.nan] * 14 + [100 * g / (g + l)]
    for a, b in zip(up[14:], down[14:]):
        g, l = (g * 13 + a) / 14, (l * 13 + b) / 14
        want.append(100 * g / (g + l))
    np.testing.assert_allclose(out, want, rtol=1e-10)


def test_constant_prices(spark):
    """No range and no change: nothing may raise under ANSI arithmetic."""
    bars = series(spark, [(1, i, 5.0) for i in range(40)])
    steps = [ind.adx(), ind.supertrend_bands(), ind.rsi_sma(), ind.rsi_ewm(), ind.rsi_wilder(), ind.tmf_floor_medians(),
             ind.natr(), ind.antr(), ind.yearly_capital(), tr.lagged_wins()]
    last = compute(bars, *steps).orderBy(F.desc("bar_index")).first()
    assert last.atr == 0 and last.pdi is None and last.adx is None and last.st_up_diff_norm is None
    assert math.isnan(last.rsi) and math.isnan(last.rsi_ewm) and last.rsi_wilder == 0
    assert last.tmf_w == 0 and last.natr == 0 and last.std_vol == pytest.approx(0, abs=1e-12)
    assert last.previous_exit_success == 0 and last.previous_exit_result_ratio == 0


def test_one_bar(spark):
    bars = series(spark, [(1, 0, 5.0)])
    row = compute(bars, ind.adx(), ind.tmf_signal(), ind.yearly_capital(), tr.first_hit_exit()).first()
    assert row.tr == 0 and row.up is None and row.signal == 0
    assert row.std_vol is None and row.exit_gain_loss is None


def test_first_bar_true_range(spark):
    bars = series(spark, [(1, 0, 5.0), (1, 9, 8.0)]).withColumn("high", F.col("high") + 1)
    got = [r.tr for r in compute(bars, ind.true_range()).orderBy("bar_index").collect()]
    assert got == [1.0, 4.0]


def test_gaps_in_dates_do_not_matter_to_bar_windows(spark):
    close = [1.0, 3.0, 2.0, 5.0]
    near = series(spark, [(1, i, x) for i, x in enumerate(close)])
    far = series(spark, [(1, 400 * i, x) for i, x in enumerate(close)])
    a = compute(near, ind.atr()).orderBy("bar_index").select("atr").collect()
    assert a == compute(far, ind.atr()).orderBy("bar_index").select("atr").collect()


def test_long_window_spread(spark):
    bars = series(spark, [(1, i, 1.0) for i in range(1500)]).withColumn("volume", F.col("bar_index").cast("double"))
    bars = bars.withColumn("volume", F.when(F.col("bar_index") % 50 == 0, None).otherwise(F.abs(F.sin("volume")) * 100))
    out = compute(bars, ind.yearly_capital(), block=300).orderBy("bar_index").toPandas()
    x = np.log10(out["volume"] + 1)
    np.testing.assert_allclose(out["std_vol"], x.rolling(261, min_periods=2).std(), rtol=1e-9)
    np.testing.assert_allclose(out["yearly_cap_xchngd"], out["cap_xchgd_approx"].rolling(261, min_periods=1).sum(), rtol=1e-12)


def test_division(spark):
    rows = [(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (6.0, 3.0), (None, 0.0), (1.0, None)]
    df = spark.createDataFrame(rows, "n double, d double")
    got = [r[0] for r in df.select(ieee_div(F.col("n"), F.col("d"))).collect()]
    assert got[0] == math.inf and got[1] == -math.inf and math.isnan(got[2])
    assert got[3:] == [2.0, None, None]
    nans = spark.createDataFrame([(math.nan,), (2.0,), (None,)], "x double")
    assert [r[0] for r in nans.select(nan_to(F.col("x"), 0.0)).collect()] == [0.0, 2.0, None]


@pytest.mark.parametrize("com", [0.1, 1])
def test_steep_averages_under_long_look_backs(spark, com):
    """What looks back at a steep average gets right values, however far that is."""
    x = walk(6000, 8)
    bars = series(spark, [(1, i, float(v)) for i, v in enumerate(x)])
    mean = ind.ewm("close", com, "e")
    low = Step("low", lambda w: [{"low": F.min("e").over(w.rowsBetween(-1999, 0))}], (mean,), back=1999)
    other = ind.ewm("close", 25, "slow")
    out = compute(bars, low, other, block=700).orderBy("bar_index").toPandas()
    want = pd.Series(x).ewm(com=com).mean()
    np.testing.assert_allclose(out["e"], want, rtol=1e-9)
    np.testing.assert_allclose(out["low"], want.rolling(2000, min_periods=1).min(), rtol=1e-9)
    np.testing.assert_allclose(out["slow"], pd.Series(x).ewm(com=25).mean(), rtol=1e-9)
