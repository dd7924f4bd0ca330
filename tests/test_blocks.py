"""Results must not depend on how series are cut into blocks."""

import random

import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import series
from tickloom.functions.sliding import least_of, sliding, spread_samp, total
from tickloom.operators import indicators as ind
from tickloom.operators import reports, windows
from tickloom.operators import series as whole
from tickloom.operators import trades as tr
from tickloom.plans.layout import index_bars, settle, spread
from tickloom.plans.scan import MAX, MIN, PRODUCT, SUM, dense_rank_by, number_rows, running
from tickloom.plans.steps import compute

KEY = ["ticker", "bar_index"]

STEPS = {
    "signal": lambda: [ind.tmf_signal()],
    "signal_incl": lambda: [ind.tmf_signal_incl()],
    "medians": lambda: [ind.tmf_floor_medians()],
    "medians_incl": lambda: [ind.tmf_floor_medians_incl()],
    "macd": lambda: [ind.macd(), ind.macd_signal()],
    "rsi": lambda: [ind.rsi_sma(), ind.rsi_wilder()],
    "adx": lambda: [ind.adx()],
    "bands": lambda: [ind.supertrend_bands()],
    "ranges": lambda: [ind.natr(), ind.antr(), ind.dd_sign_count()],
    "capital": lambda: [ind.yearly_capital()],
    "exits": lambda: [tr.first_hit_exit(), tr.exit_from_signal_bar(tr.WIDE)],
    "past": lambda: [tr.lagged_wins()],
    "past_incl": lambda: list(tr.lagged_wins_incl()),
    "smoothing": lambda: [ind.ema_lag_sum("close", 5, "standard", "a"), ind.ema_mean_tail("close", 5, "standard", "b")],
    "shifts": lambda: [windows.lag_lead("close"), windows.history_lists("close", 5, "h")],
}


def frame(df):
    return df.toPandas().sort_values(KEY).reset_index(drop=True)


@pytest.mark.parametrize("name", STEPS)
def test_steps(bars, name):
    large, small = compute(bars, *STEPS[name]()), compute(bars, *STEPS[name](), block=97)
    pd.testing.assert_frame_equal(frame(large), frame(small), rtol=1e-9, atol=1e-9)


def test_spread_keeps_each_bar_once(bars):
    out = settle(spread(bars, back=130, ahead=12, block=50))
    assert out.count() == bars.count() == out.select(*KEY).distinct().count()


def test_a_hot_ticker_is_cut(bars):
    one = bars.where("ticker = 1")
    cut = spread(one, back=30, ahead=5, block=100)
    sizes = cut.groupBy("_block").count()
    assert sizes.agg(F.max("count")).first()[0] <= 100 + 30 + 5
    assert sizes.count() >= 5


def test_duplicates_are_refused(spark):
    rows = [(1, 0, 1.0), (1, 0, 2.0)]
    with pytest.raises(Exception, match="unique"):
        series(spark, rows).collect()


def test_index_spans(spark, bars):
    plain = bars.drop("bar_index")
    fine = index_bars(plain, span=F.floor(F.unix_date("date") / 7))
    joined = fine.join(bars.select("ticker", "date", F.col("bar_index").alias("want")), ["ticker", "date"])
    assert joined.where("bar_index <> want").count() == 0 and joined.count() == bars.count()


@pytest.mark.parametrize("fold", [SUM, PRODUCT, MAX, MIN])
def test_running(bars, fold):
    value = F.when(F.col("volume") > 10, F.col("close") / 100)
    plain = running(bars, value, "out", fold, levels=0)
    cut = running(bars, value, "out", fold, block=7, levels=2)
    pd.testing.assert_frame_equal(
        frame(plain.select(*KEY, "out")), frame(cut.select(*KEY, "out")), rtol=1e-9
    )


@pytest.mark.parametrize("keys", [[], ["ticker"]])
@pytest.mark.parametrize("descending", [True, False])
def test_dense_rank(spark, bars, keys, descending):
    df = bars.select("ticker", "bar_index", F.when(F.col("volume") > 5, F.col("volume")).alias("v"))
    df = df.withColumn("v", F.when(F.col("v") == 7, float("nan")).when(F.col("v") == 9, float("inf")).otherwise(F.col("v")))
    out = frame(dense_rank_by(df, keys, "v", "rank", descending, buckets=5))
    known = out.dropna(subset=["rank"])
    # NaN sorts above every number.
    values = known["v"].fillna(1e300).replace(float("inf"), 1e200)
    want = (
        values.groupby(known["ticker"]).rank(method="dense", ascending=not descending)
        if keys
        else values.rank(method="dense", ascending=not descending)
    )
    assert (known["rank"] == want).all()
    assert len(out) == bars.count()


def test_number_rows(bars):
    out = number_rows(bars, F.xxhash64("ticker", "date"), F.pmod(F.xxhash64("date"), F.lit(16)), "n")
    numbers = sorted(r.n for r in out.select("n").collect())
    assert numbers == list(range(1, bars.count() + 1))


@pytest.mark.parametrize(
    "steps", [lambda: [tr.first_hit_exit()], lambda: [ind.ema_truncated_fold("close", 12, "standard", "a")]]
)
def test_no_list_is_built_for_every_row(bars, steps):
    assert "collect_list" not in compute(bars, *steps())._jdf.queryExecution().sparkPlan().toString()


def test_fold_is_null_where_a_value_is_missing(spark):
    """The fold of a frame, from its oldest value on, and NULL until all its values are there."""
    closes = [float(day * 7 % 11) for day in range(12)]
    closes[7] = None
    rows = series(spark, [(1, day, close) for day, close in enumerate(closes)])
    out = compute(rows, ind.ema_truncated_fold("close", 3, "standard", "a", period_as_lookback=True)).orderBy("bar_index")
    for place, row in enumerate(out.collect()):
        values = closes[max(place - 3, 0) : place + 1]
        if len(values) < 4 or None in values:
            assert row.a is None
            continue
        want = values[0] * (1 / 0.5 - 1) / 0.5
        for value in values:
            want = want * 0.5 + value
        assert row.a == pytest.approx(want * 0.5, rel=1e-14)


def test_block_copies_are_placed_after_the_exchange(bars):
    """The exchange carries no column that can be worked out from the bar's number."""
    plan = compute(bars.select("ticker", "date", "bar_index", "close"), ind.macd())._jdf.queryExecution().sparkPlan().toString()
    assert plan.index("_offset") < plan.index("REPARTITION_BY_COL") and "_offset" not in plan[plan.index("REPARTITION_BY_COL"):]


def test_recursive_bands(bars):
    rows = compute(bars, ind.atr())
    large = frame(whole.supertrend_recursive(rows, 2))
    small = frame(whole.supertrend_recursive(rows, 2, block=16, group=4))
    pd.testing.assert_frame_equal(large, small)
    assert set(large["direction"]) == {1, -1}


def test_recursive_bands_after_the_year_9999(spark):
    """Dates that Python does not know go through the loop over bars as whole numbers."""
    rows = [(1, 5_000_000 + day, 100.0 + day * 7 % 11) for day in range(60)]
    out = whole.supertrend_recursive(compute(series(spark, rows), ind.atr()), 2, block=16, group=2)
    assert out.schema["date"].dataType.typeName() == "date"
    days = out.select(F.datediff("date", F.lit("2000-01-01").cast("date")).alias("day")).orderBy("day").collect()
    assert [r.day for r in days] == [day for _, day, _ in rows]


@pytest.mark.parametrize("seed,jump,group", [(1, 2, 2), (2, 9, 3), (3, 30, 2), (4, 0.3, 2), (5, 4, 100)])
def test_recursive_bands_against_a_loop(spark, seed, jump, group):
    """Blocks of a few bars, which bands and direction pass without a crossing, with one at their edges, or with many."""
    draw = random.Random(seed)
    rows = [(t, day, 100.0 + (close := (close if day else 0) + draw.choice([-1, 0, 1, draw.uniform(-jump, jump)])))
            for t in range(8) for day in range(59 + t)]
    # drifting for a while, so that a direction holds over many blocks
    rows = [(t, day, close + 2 * day * (t % 3 - 1)) for t, day, close in rows]
    bars = compute(series(spark, rows), ind.atr(), block=4, blocks=True)
    got = frame(whole.supertrend_recursive(bars, 1, block=4, group=group))
    pd.testing.assert_frame_equal(got, frame(whole.supertrend_recursive(bars.drop("_block"), 1, block=16, group=group)))
    want = []
    for _, one in frame(bars).groupby("ticker"):
        up = low = before = None
        for close, atr in zip(one["close"], one["atr"]):
            new_up, new_low = close + atr, close - atr
            way = 1 if before is None or close > up else -1 if close < low else way
            up = new_up if before is None or new_up < up or before > up else up
            low = new_low if before is None or new_low > low or before < low else low
            before = close
            want.append((up, low, way))
    assert list(zip(got["upperband"], got["lowerband"], got["direction"])) == want


def test_rows_before_the_wanted_ones_are_left_behind(bars):
    """With ``due``, wanted rows are as without it, for steps of any reach, over blocks, and fewer rows go through the later ones."""
    due = F.when(F.col("ticker") % 2 == 0, 300).otherwise(431).cast("bigint")
    steps = [ind.yearly_capital(), tr.lagged_wins(), ind.tmf_floor_medians_incl(), ind.adx(), ind.supertrend_bands()]
    given = bars.withColumn("due_from", due)
    wanted = F.col("bar_index") >= F.col("due_from")
    want, part = frame(compute(given, *steps).where(wanted)), frame(compute(given, *steps, block=100, due="due_from"))
    got = part[part["bar_index"] >= part["due_from"]].reset_index(drop=True)
    pd.testing.assert_frame_equal(got[sorted(got)], want[sorted(want)], rtol=1e-12, atol=1e-12)
    assert len(part) < bars.count()


def test_least_and_long_sums_of_any_length(spark):
    """Against plain frames, with missing values, NaN, and series shorter than the frame."""
    draw = random.Random(4)
    value = lambda: draw.choice([None, float("nan"), *[draw.uniform(-9, 9) for _ in range(8)]])
    rows = series(spark, [(t, day, value()) for t in (1, 2) for day in range(12 + 70 * t)]).withColumn("x", F.nanvl("close", F.lit(5.0)))
    w = Window.partitionBy("ticker").orderBy("bar_index")
    out = plain = rows
    for count in (1, 2, 7, 8, 20, 61):
        low, all_, sd = names = [f"{n}_{count}" for n in ("low", "all", "sd")]
        tracks = {all_: total(F.col("x")), sd: spread_samp(F.col("x"))}
        for layer in [*least_of("close", low, count, w), *sliding(tracks, count, w, "t")]:
            out = out.withColumns(layer)
        out = out.drop(*[c for c in out.columns if c.startswith("_")])
        over = w.rowsBetween(1 - count, 0)
        plain = plain.withColumns(dict(zip(names, (F.min("close").over(over), F.sum("x").over(over), F.stddev_samp("x").over(over)))))
    pd.testing.assert_frame_equal(frame(out), frame(plain), rtol=1e-12, atol=1e-12)


def test_blocks_out_of_order_are_refused(spark):
    rows = series(spark, [(1, day, 100.0 + day) for day in range(40)])
    placed = compute(rows, ind.atr(), block=8, blocks=True)
    with pytest.raises(Exception, match="does not hold its positions"):
        whole.supertrend_recursive(placed, 2, block=16).collect()
    with pytest.raises(ValueError, match="at most"):
        compute(rows, ind.ewm("close", 13, "e"), block=100_000, blocks=True)


def test_series_without_their_first_bars_go_on(spark):
    """A bar without a date is numbered and left out, so a series may begin at its second bar."""
    rows = series(spark, [(t, day, 100.0 + day * 7 % 11) for t in (1, 2) for day in range(40)])
    placed = compute(rows.where("bar_index > ticker"), ind.atr(), block=8, blocks=True)
    got, want = (frame(whole.supertrend_recursive(df, 2, block=8)) for df in (placed, placed.drop("_block")))
    pd.testing.assert_frame_equal(got, want)
    assert len(got) == 77


def test_recursive_bands_exchange_the_bars_once(bars):
    """Both passes over the bars read one exchange, and nothing is written between them."""
    out = whole.supertrend_recursive(compute(bars, ind.atr(), block=64, blocks=True), 2, block=64)
    out.collect()
    final = out._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan ==")[0]
    assert "ReusedExchange" in final and "ExistingRDD" not in final
    assert final.count("REPARTITION_BY_COL") == 2  # in the place of its making and where it is used again


@pytest.mark.parametrize("every,longest", [(3, 13), (2, 6), (1000, 13)])
def test_positions(bars, every, longest):
    """Against a plain loop, also with signals on almost every bar."""
    signals = bars.where(F.pmod(F.xxhash64("bar_index"), F.lit(every)) != 0).withColumn(
        "exit_bar",
        F.col("bar_index") + 1 + F.pmod(F.xxhash64("ticker", "bar_index"), F.lit(longest - 1)),
    )
    got = frame(whole.nonoverlapping(signals, longest, block=16, group=4))
    want = []
    for _, one in frame(signals).groupby("ticker"):
        free = 0
        for bar, end in zip(one["bar_index"], one["exit_bar"]):
            want.append(bar >= free)
            free = end if bar >= free else free
    assert got["taken"].tolist() == want


def test_calendar_windows(bars):
    frames = {"low_28": (F.min, "close", 28)}
    large = windows.calendar_rolling(bars, frames)
    small = windows.calendar_rolling(bars, frames, block_days=10)
    pd.testing.assert_frame_equal(frame(large), frame(small))


def test_top_is_the_rank_filter(spark, folder):
    from tickloom.catalog import views

    years = views.trade_year(spark, folder)
    ranked = reports.ranked_by_year(years).where("drnk < 3").select("ticker", "year", "drnk")
    top = reports.top_by_year(years, 3).select("ticker", "year", "drnk")
    assert sorted(map(tuple, ranked.collect())) == sorted(map(tuple, top.collect()))
