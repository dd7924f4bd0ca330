"""The plans behind the results: exchanges, scans, and no Python in the rolling path."""

import re

from pyspark.sql import functions as F

from tickloom.catalog import views
from tickloom.operators import features, metrics, reports
from tickloom.operators import indicators as ind
from tickloom.operators import trades as tr
from tickloom.plans.steps import compute, in_order
from tickloom.sources import bars as src
from tickloom.sources.store import table


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(text):
    return len(re.findall(r"(?<!Broadcast)Exchange ", text))


def test_all_features_need_one_exchange(bars):
    text = plan(features.feature_table(bars))
    assert exchanges(text) == 1
    assert len(re.findall(r"\bSort \[", text)) == 1
    assert "Python" not in text and "Join" not in text


def test_features_need_few_passes_over_the_rows(bars):
    """Also on a stream, where rows are left behind on the way."""
    steps = features.feature_steps()
    given = bars.withColumn("due_from", F.lit(300).cast("bigint"))
    for df in (compute(bars, *steps), compute(given, *steps, due="due_from")):
        text = plan(features.signal_features(df))
        assert len(re.findall(r"\bWindow \[", text)) <= 13 and len(re.findall(r"\bSort \[", text)) == 1


def test_quantiles_share_the_exchange_and_build_no_lists(bars):
    text = plan(compute(bars, ind.tmf_floor_medians_incl(), ind.percentile_gap("tmf_t", 260, "gap", (ind.tmf_truncated(),))))
    assert exchanges(text) == 1 and len(re.findall(r"\bSort \[", text)) == 1
    assert "collect_list" not in text and text.count("FlatMapGroupsInArrow") == 1


def test_only_used_columns_are_read(bars):
    text = plan(compute(bars, ind.macd(), select=["ticker", "date", "macd"]))
    scanned = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert set(c.split(":")[0] for c in scanned.split(",")) == {"ticker", "date", "close", "bar_index"}


def test_a_ticker_filter_reaches_the_scan(bars):
    out = compute(bars.where(F.col("ticker") == 3), ind.tmf_signal(), select=["ticker", "signal"])
    assert "EqualTo(ticker,3)" in plan(out)


def test_shared_steps_appear_once():
    names = [s.name for s in in_order([ind.adx(), ind.atr(), ind.supertrend_bands(), ind.natr(), tr.lagged_wins()])]
    assert len(names) == len(set(names))
    assert sum(n.startswith("atr") for n in names) == 1


def test_bars_are_summed_up_before_the_exchange(spark, folder):
    text = plan(src.shipment_bars(table(spark, folder, "lineitem")))
    assert "partial_min_by" in text and exchanges(text) == 1


def test_grid_is_one_pass(spark, folder):
    text = plan(metrics.metric_grid(views.predictions(spark, folder)))
    assert text.count("FileScan") == 1 and "CartesianProduct" not in text and "NestedLoop" not in text


def test_no_window_over_everything(spark, folder):
    years = views.trade_year(spark, folder)
    for df in (reports.ranked_by_year(years), reports.rank_by_product(views.trades(spark, folder))):
        assert "CartesianProduct" not in plan(df)
