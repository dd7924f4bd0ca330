"""Sources, strategy interface and model jobs."""

import pytest
from pyspark.sql import functions as F

from tickloom.catalog import prediction, views
from tickloom.operators import features, models
from tickloom.operators import strategy as st
from tickloom.operators import trades as tr
from tickloom.session import shared_folder
from tickloom.sources import bars as src
from tickloom.sources import store


# ---- sources ---------------------------------------------------------------------------


def test_absent_columns_are_null(spark, tmp_path):
    path = str(tmp_path / "bars")
    spark.range(2).selectExpr("id * 86400000000000L AS Date", "'A' AS Ticker", "1.5D AS Close").write.parquet(path)
    rows = src.tidy(src.scan_bars(spark, path)).orderBy("date").collect()
    assert [str(r.date) for r in rows] == ["1970-01-01", "1970-01-02"]
    assert rows[0].close == 1.5 and rows[0].adj_close is None and rows[0].stock_splits is None


def test_nanosecond_files(spark, tmp_path):
    """Files as a data-frame library writes them, with nanosecond timestamps."""
    import pandas as pd
    import pyarrow as pa
    import pyarrow.parquet as pq

    days = pd.to_datetime(["2000-01-03", "2000-01-04"]).astype("datetime64[ns]")
    frame = pd.DataFrame({"Date": days, "Ticker": "A", "Close": [1.0, 2.0], "Volume": [10.0, 20.0]})
    pq.write_table(pa.Table.from_pandas(frame), str(tmp_path / "bars.parquet"), version="2.6")
    (tmp_path / "notes.txt").write_text("not a bar file")
    rows = src.tidy(src.scan_bars(spark, str(tmp_path), glob="*.parquet")).orderBy("date").collect()
    assert [(str(r.date), r.ticker, r.close, r.open) for r in rows] == [
        ("2000-01-03", "A", 1.0, None), ("2000-01-04", "A", 2.0, None),
    ]


def test_dates_before_1970(spark):
    df = spark.createDataFrame([(-1,), (0,), (-86_400_000_000_000,)], "ns bigint")
    got = [str(r[0]) for r in df.select(src.ns_to_date(F.col("ns"))).collect()]
    assert got == ["1969-12-31", "1970-01-01", "1969-12-31"]


def test_feeds_keep_their_names(spark):
    a, b = spark.range(1).selectExpr("1 AS x"), spark.range(1).selectExpr("2 AS x", "3 AS y")
    got = sorted(tuple(r) for r in src.union_feeds({"a": a, "b": b}).select("feed", "x", F.coalesce("y", F.lit(0))).collect())
    assert got == [("a", 1, 0), ("b", 2, 3)]
    with pytest.raises(ValueError):
        src.union_feeds({})


def test_newest_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x\n1\n")
    (tmp_path / "b.csv").write_text("x\n2\n")
    import os

    os.utime(tmp_path / "a.csv", (2_000_000_000, 2_000_000_000))
    schema = spark.range(0).selectExpr("1 AS x").schema
    assert [r.x for r in store.read_latest_csv(spark, str(tmp_path), schema).collect()] == [1]
    with pytest.raises(FileNotFoundError):
        store.newest_file(spark, str(tmp_path), "*.none")


def test_shared_folder_is_the_named_one(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert shared_folder(spark) == named if named else shared_folder(spark)


# ---- strategy ----------------------------------------------------------------------------


def test_same_request_same_uid(bars):
    test = st.Backtest()
    test.add_data(bars)
    first = test.add_indicator(st.ewm_mean, ["close"], com=11)
    assert first == test.add_indicator(st.ewm_mean, ["close"], com=11)
    assert first != test.add_indicator(st.ewm_mean, ["close"], com=12)
    assert first != test.add_indicator(st.ewm_mean, ["open"], com=11)
    assert len(test.steps) == 3
    a, b = test.add_indicator(st.difference, ["open", "close"]), test.add_indicator(st.difference, ["close", "open"])
    assert a != b


def test_needs_a_strategy(bars):
    test = st.Backtest()
    test.add_data(bars)
    with pytest.raises(ValueError):
        test.run()


def test_costs_and_shares(bars):
    test = st.Backtest()
    test.add_data(bars)
    lows = test.add_indicator(st.rolling_min, ["close"], count=20)
    pulse = test.add_indicator(st.turns_flat, [test.add_indicator(st.change, [lows])])
    test.add_strategy(pulse, lows, st.share_of_strength)
    test.add_broker(tr.net_ratio)
    out = test.run()
    done = out.where("exit_gain_loss IS NOT NULL")
    assert done.where("abs(exit_gain_loss - 0.002 - net_ratio) > 1e-12").count() == 0
    days = out.groupBy("date").agg(F.sum("allocation").alias("s"))
    assert days.where("abs(s - 1) > 1e-9").count() == 0 and days.count() > 0


# ---- models --------------------------------------------------------------------------------


def test_split_and_complete(spark, folder):
    rows = prediction.split_rows(spark, folder)
    assert rows.select("split").distinct().count() == 3
    assert rows.where(F.isnan("adx") | F.col("adx").isNull()).count() == 0
    assert set(features.FEATURES) <= set(rows.columns) and len(features.FEATURES) == 22


def test_registered_search_has_all_trials(spark, folder, monkeypatch):
    def search(rows, trials):
        return spark.createDataFrame([(n, k, "", "", 0.0) for n, (k, _) in enumerate(trials)], models.SEARCH_SCHEMA), 0

    monkeypatch.setattr(models, "param_search", search)
    assert prediction.param_search(spark, folder).select("trial").distinct().count() == models.TRIALS == 100


def test_trials_are_repeatable():
    a, b = models.random_trials(20), models.random_trials(20)
    assert a == b and {k for k, _ in a} == set(models.KINDS)
    assert all(2 <= p["max_depth"] <= 10 for _, p in a)


def test_search_finds_the_best(spark, folder):
    rows = prediction.split_rows(spark, folder)
    ledger, best = models.param_search(rows, [("decision_tree", {"max_depth": 2}), ("random_forest", {"max_depth": 3, "trees": 3})])
    goal = ledger.where(F.col("metric") == "vldt_" + models.OBJECTIVE).orderBy(F.desc("value"), "trial").first()
    assert goal.trial == best
    assert ledger.where("metric LIKE 'test__%'").count() == 2 * 23


def test_importance_finds_the_used_feature(spark):
    """The target hangs on one feature only; shuffling the other changes nothing."""
    rows = spark.range(400).select(
        F.lit(1).alias("ticker"), F.col("id").alias("date"),
        (F.col("id") % 17).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b"),
    ).withColumn("target", F.col("a") * 2)
    model = models.fit(rows, "decision_tree", {"max_depth": 8}, ["a", "b"])
    got = {r.feature: r for r in models.permutation_importance(model, rows, ["a", "b"], repeats=4).collect()}
    assert got["a"].importance_mean > 1 and got["b"].importance_mean == pytest.approx(0, abs=1e-9)


def test_views_are_whole(spark, folder, bars):
    days = table_days(spark, folder)
    assert bars.count() == days
    assert views.predictions(spark, folder).count() == store.table(spark, folder, "lineitem").count()


def table_days(spark, folder):
    lines = store.table(spark, folder, "lineitem")
    return lines.select("l_suppkey", F.col("l_shipdate").cast("date")).distinct().count()


@pytest.mark.parametrize(
    ("kind", "params"),
    [
        ("decision_tree", {"max_depth": 0}), ("decision_tree", {"max_depth": 4}),
        ("random_forest", {"max_depth": 3, "trees": 3}), ("gradient_boosting", {"max_depth": 2, "iterations": 3}),
    ],
)
def test_trees_as_arrays_predict_the_same(spark, kind, params):
    import numpy as np

    rows = spark.range(200).selectExpr("cast(id % 17 as double) AS a", "cast(id * 7 % 23 as double) AS b", "a * b + a AS target")
    model = models.fit(rows, kind, params, ["a", "b"])
    got = np.array([tuple(r) for r in models.predict(model, rows).select("a", "b", "y_pred").collect()])
    made = sum(t.weight * t.predict(got[:, :2]) for t in models.node_arrays(model))
    assert made == pytest.approx(got[:, 2], rel=1e-12)


def test_importance_of_an_unused_feature_is_zero(spark):
    rows = spark.range(100).selectExpr(
        "id AS ticker", "current_date() AS date", "cast(id as double) AS a", "1.0D AS b", "cast(id as double) AS target"
    )
    model = models.fit(rows, "decision_tree", {"max_depth": 2}, ["a", "b"])
    out = models.permutation_importance(model, rows, ["a", "b"], repeats=3)
    got = {r.feature: (r.importance_mean, r.importance_std) for r in out.collect()}
    assert got["b"] == (0.0, 0.0) and got["a"][0] > 0
    assert models.permutation_importance(model, rows.limit(0), ["a", "b"], repeats=3).collect() == []


def test_donors_of_an_importance_are_not_broadcast(spark):
    """Row sizes are judged before the repeats are made, so the repeated rows must not go through the driver."""
    rows = spark.range(50).selectExpr("id AS ticker", "current_date() AS date", "cast(id as double) AS a", "cast(id as double) AS target")
    model = models.fit(rows, "decision_tree", {"max_depth": 2}, ["a"])
    plan = models.permutation_importance(model, rows, ["a"], repeats=3)._jdf.queryExecution().sparkPlan().toString()
    pairs = [line for line in plan.splitlines() if "Join [place" in line]
    assert pairs and all("SortMergeJoin" in line for line in pairs)


def test_the_last_day_is_selected_by_many_tasks(spark, folder, monkeypatch):
    """The bars are read side by side, and only those of the last day come together for their file."""
    from tickloom.catalog import tables

    plans = []
    write = store.write_csv
    monkeypatch.setattr(store, "write_csv", lambda df, path: (plans.append(df._jdf.queryExecution().sparkPlan().toString()), write(df, path)))
    assert tables.latest_csv(spark, folder).count() > 0
    assert "Coalesce" not in plans[1] and "Exchange SinglePartition" in plans[1]


@pytest.mark.parametrize("name", ["bars", "long_bars"])
def test_lines_are_exchanged_once_for_numbered_bars(spark, folder, monkeypatch, name):
    """Numbering brings no second exchange of whole bars: what is exchanged but the lines is a run's count."""
    from tickloom.catalog import long

    built = []
    make = {"bars": views.bars, "long_bars": long.long_bars}[name]
    for module in (views, long):
        monkeypatch.setattr(module, "layer", lambda s, f, n, build: built.append(build()) or built[-1])
    make(spark, folder)
    plan = built[-1]._jdf.queryExecution().executedPlan().toString()
    lines = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(built) == 1 and sum("REPARTITION_BY_COL" in line for line in lines) == 2
