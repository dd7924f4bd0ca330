"""Small cases worked out by hand."""

import datetime

import pytest
from pyspark.sql import functions as F

from conftest import series
from tickloom.functions import arrays as arr
from tickloom.functions.smoothing import lookback_of
from tickloom.operators import indicators as ind
from tickloom.operators import metrics, windows
from tickloom.operators import trades as tr
from tickloom.plans.steps import Step, compute

PREDICTIONS = [
    ("2001-01-01", 0.95, 1.02), ("2001-01-02", 1.02, 1.03), ("2001-02-01", 1.03, 1.04), ("2001-02-02", 0.95, 1.05),
    ("2001-03-01", 0.95, 1.1), ("2001-03-02", 0.8, 1.1), ("2001-04-01", 1.1, 0.95), ("2001-04-02", 1.1, 0.8),
]


@pytest.fixture(scope="module")
def predictions(spark):
    df = spark.createDataFrame(PREDICTIONS, "date string, y_true double, y_pred double")
    return df.withColumn("date", F.col("date").cast("date"))


def one(df):
    return df.first()[0]


def test_monthly_scores(predictions):
    assert one(metrics.monthly_win_avg(predictions, 1)) == pytest.approx(0.333333, abs=1e-6)
    assert one(metrics.monthly_win_std(predictions, 1)) == pytest.approx(0.235702, abs=1e-6)
    assert one(metrics.monthly_return_avg(predictions, 1)) == pytest.approx(0.95)
    assert one(metrics.monthly_return_std(predictions, 1)) == pytest.approx(0.053072, abs=1e-6)
    assert one(metrics.precision_at(predictions, 1)) == pytest.approx(1 / 3)
    assert one(metrics.true_positive_at(predictions, 1)) == 2.0
    assert tuple(metrics.confusion_at(predictions, 1).first()) == (2, 4, 2, 0)


def test_scores_without_any_prediction(predictions):
    assert one(metrics.precision_at(predictions, 2)) == 0
    assert one(metrics.monthly_win_avg(predictions, 2)) == 0
    assert one(metrics.monthly_win_std(predictions, 2)) == 0
    assert one(metrics.monthly_return_avg(predictions, 2)) == 1
    assert one(metrics.monthly_return_std(predictions, 2)) == 0
    assert metrics.monthly_return(predictions, 2).count() == 0
    assert metrics.yearly_return(predictions, 2).count() == 0


def test_one_month_has_no_spread(predictions):
    january = predictions.where("date < '2001-02-01'")
    assert one(metrics.monthly_win_std(january, 1)) == 0
    assert one(metrics.monthly_return_std(january, 1)) == 0


def test_grid_equals_single_scores(predictions):
    grid = dict(metrics.metric_grid(predictions, (1.0,)).collect())
    assert grid["monthly_win_ratio_avg__threshold_1.0"] == pytest.approx(0.333333, abs=1e-6)
    assert grid["mthly_rtrn_pct_std__threshold_1.0"] == pytest.approx(0.053072, abs=1e-6)
    y, p = [r[1] for r in PREDICTIONS], [r[2] for r in PREDICTIONS]
    assert grid["mean_absolute_error"] == pytest.approx(sum(abs(a - b) for a, b in zip(y, p)) / 8)
    cubic = sum((a - b) ** 2 / (a * b * b) for a, b in zip(y, p)) / 8
    assert grid["mean_tweedie_deviance__power_3"] == pytest.approx(cubic)
    assert len(grid) == 6 + 5


def test_truncated_average(spark):
    values = [1.1, 1.0, 1.1, 2.0, 1.1, 1.1, 3.0, 1.1, 1.1, 4.0, 1.1, 5.0, 1.1, 1.1, 1.1]
    rows = [(1, i, x) for i, x in enumerate(values)] + [(2, 0, 1.1), (2, 1, 1.1)]
    out = compute(
        series(spark, rows),
        ind.ema_truncated_fold("close", 2, "wilder", "hof"), ind.ema_truncated("close", 2, "wilder", "sums"),
        ind.ema_lag_sum("close", 2, "wilder", "lags"),
    ).orderBy("ticker", "date")
    got = [(r.hof, r.sums, r.lags) for r in out.collect()]
    assert got[:10] == [(None,) * 3] * 10 and got[15:] == [(None,) * 3] * 2
    expected = [1.88779297, 3.44384766, 2.27197266, 1.68642578, 1.39277344]
    for forms, want in zip(got[10:15], expected):
        assert forms == pytest.approx((want,) * 3, abs=1e-8)


def test_lookbacks():
    assert [lookback_of(p, "standard") for p in (12, 26, 9)] == [42, 90, 31]
    assert lookback_of(14, "wilder") == 94
    assert lookback_of(14, "wilder", period_as_lookback=True) == 14


def test_first_hit_exit(spark):
    rows = [(1, i, float(x)) for i, x in enumerate([1, 2, 3, 4])]
    rows += [(2, i, float(x)) for i, x in enumerate([5, 6, 4, 3])]
    out = compute(series(spark, rows), tr.first_hit_exit(tr.ExitRule(1, 1.05, 0.95)))
    got = {(r.ticker, r.date.day): r for r in out.collect()}
    first, second = got.pop((1, 1)), got.pop((2, 1))
    assert (first.entry_price, first.exit_point, first.exit_price, first.exit_gain_loss) == (2, 2, 4, 2)
    assert first.exit_reason == "gain" and first.exit_date == datetime.date(2000, 1, 4)
    assert (second.entry_price, second.exit_point, second.exit_price, second.exit_gain_loss) == (6, 2, 3, 0.5)
    assert second.exit_reason == "loss"
    assert all(r.exit_gain_loss is None and r.exit_reason is None for r in got.values())


def test_exit_by_period(spark):
    rows = [(1, i, 10.0) for i in range(14)]
    got = compute(series(spark, rows), tr.first_hit_exit(tr.ExitRule(10))).orderBy("date").collect()
    assert got[0].exit_reason == "period" and got[0].exit_point == 11
    assert got[1].exit_reason == "period" and got[2].exit_reason is None


def test_ordered_lists(spark):
    rows = [(1, 1, "A"), (1, 2, "B"), (1, -1, "C"), (2, 1, "X"), (2, 2, "Y")]
    df = spark.createDataFrame(rows, "id int, timestamp int, value string")
    out = windows.expanding_list(df, ["id"], "timestamp", "value", "seen")
    got = {(r.id, r.timestamp): r.seen for r in out.collect()}
    assert got == {(1, -1): ["C"], (1, 1): ["C", "A"], (1, 2): ["C", "A", "B"], (2, 1): ["X"], (2, 2): ["X", "Y"]}


def test_rolling_lists(spark):
    rows = [(1, 0, 1.0), (1, 1, 2.0), (1, 2, 3.0), (2, 0, 5.0), (2, 1, 6.0), (2, 2, 4.0)]
    lists = Step("lists", lambda w: [{"l": F.collect_list("close").over(w.rowsBetween(-1, 0))}], back=1)
    out = compute(series(spark, rows), lists).orderBy("ticker", "date").collect()
    assert [r.l for r in out] == [[1], [1, 2], [2, 3], [5], [5, 6], [6, 4]]


def test_arg_max(spark):
    df = spark.createDataFrame([([1, 2, 3, 3],), ([2, 1, 3, 3],), ([1, 3, 3, 2],)], "a array<bigint>")
    assert [r[0] for r in df.select(arr.arg_max(F.col("a"))).collect()] == [2, 2, 1]


def test_all_above_counts_nan(spark):
    df = spark.createDataFrame([([2.0, float("nan")],), ([2.0, 1.0],), ([],)], "a array<double>")
    assert [r[0] for r in df.select(arr.all_above(F.col("a"), 1)).collect()] == [True, False, True]


def test_medians(spark):
    rows = [([],), ([3.0],), ([1.0, 2.0],), ([1.0, 2.0, 4.0, 9.0],)]
    df = spark.createDataFrame(rows, "a array<double>")
    a = F.col("a")
    picks = df.select(*[arr.list_quantile(a, 0.5, kind) for kind in ("linear", "nearest", "lower")])
    assert [tuple(r) for r in picks.collect()] == [(None, None, None), (3, 3, 3), (1.5, 2, 1), (3, 4, 2)]
