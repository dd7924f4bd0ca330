"""Streams in several micro-batches give what the batch operators give."""

import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.catalog import live
from tickloom.operators import indicators as ind
from tickloom.operators import trades as tr
from tickloom.plans.layout import index_bars
from tickloom.plans.steps import Step, compute
from tickloom.streaming import bars as sb
from tickloom.streaming import idle
from tickloom.streaming import indicators as si
from tickloom.streaming.steps import StepStream



@pytest.fixture
def yearly_files(bars, tmp_path):
    """Bars written in time order, a few files for each year."""
    path = str(tmp_path / "bars")
    sb.write_in_time_order(bars, path)
    return path


def run(spark, stream, tmp_path, name):
    out, checkpoint = str(tmp_path / name), str(tmp_path / f"{name}-checkpoint")
    query = sb.run_to_parquet(stream, out, checkpoint)
    return query, sb.read_batches(spark, out, stream.schema)


def equal(got, want, columns):
    key = ["ticker", "date"]
    a, b = (d.select(*key, *columns).toPandas().sort_values(key).reset_index(drop=True) for d in (got, want))
    pd.testing.assert_frame_equal(a, b, rtol=1e-9, atol=1e-9, check_dtype=False)


def test_averages_over_batches(spark, bars, yearly_files, tmp_path):
    source = sb.parquet_stream(spark, yearly_files, bars.schema, files_per_trigger=1)
    query, got = run(spark, si.ewm_stream(source), tmp_path, "ewm")
    assert len([p for p in query.recentProgress if p["numInputRows"]]) >= 7
    want = compute(bars, ind.ewm("close", 13, "ema_close"), ind.tmf(), ind.rsi_ewm())
    equal(got, want, ["ema_close", "tmf_w"])
    off_pole = F.abs("rsi_ewm") < 1000
    joined = got.join(want.select("ticker", "date", F.col("rsi_ewm").alias("w")).where(F.abs("w") < 1000), ["ticker", "date"])
    assert joined.where(off_pole & (F.abs(F.col("rsi_ewm") - F.col("w")) > 1e-6)).count() == 0


def test_signal_over_batches(spark, bars, yearly_files, tmp_path):
    source = sb.parquet_stream(spark, yearly_files, bars.schema, files_per_trigger=2)
    _, got = run(spark, si.signal_stream(source), tmp_path, "signal")
    equal(got, compute(bars, ind.tmf_signal()), ["signal", "tmf_w", "tmf_26w_min", "tmf_26w_min_dd"])


def ticks(spark, rows, path):
    df = spark.createDataFrame(rows, "ticker string, ts string, event_id bigint, price double")
    df.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(path)
    time.sleep(0.02)


def test_late_ticks_are_dropped_and_counted(spark, tmp_path):
    path = str(tmp_path / "ticks")
    ticks(spark, [("a", "2024-01-01 10:00:00", 1, 1.0), ("a", "2024-01-01 11:00:00", 2, 3.0)], path)
    ticks(spark, [("a", "2024-01-05 10:00:00", 3, 5.0)], path)
    ticks(spark, [("a", "2024-01-05 11:00:00", 5, 2.0)], path)
    # The batch that raises the watermark and the next one still take older ticks.
    ticks(spark, [("a", "2024-01-01 12:00:00", 4, 9.0)], path)
    ticks(spark, [("a", "2024-01-09 10:00:00", 6, 7.0)], path)
    schema = spark.read.parquet(path).schema
    source = sb.parquet_stream(spark, path, schema, files_per_trigger=1)
    query, got = run(spark, sb.tumbling_bars(source), tmp_path, "bars")
    rows = [(str(r.date), r.open, r.high, r.low, r.close, r.volume) for r in got.orderBy("date").collect()]
    assert rows == [("2024-01-01", 1.0, 3.0, 1.0, 3.0, 2.0), ("2024-01-05", 5.0, 5.0, 2.0, 2.0, 2.0)]
    assert sb.dropped_late(query) == 1


def test_a_second_run_takes_only_what_is_new(spark, tmp_path):
    path = str(tmp_path / "ticks")
    ticks(spark, [("a", "2024-01-01 10:00:00", 1, 1.0)], path)
    schema = spark.read.parquet(path).schema
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    sb.run_to_parquet(sb.tumbling_bars(sb.parquet_stream(spark, path, schema)), out, checkpoint)
    ticks(spark, [("a", "2024-01-04 10:00:00", 2, 4.0)], path)
    stream = sb.tumbling_bars(sb.parquet_stream(spark, path, schema))
    sb.run_to_parquet(stream, out, checkpoint)
    got = sb.read_batches(spark, out, stream.schema).collect()
    assert [(str(r.date), r.close) for r in got] == [("2024-01-01", 1.0)]


def test_repeated_and_late_bars(spark, tmp_path):
    path = str(tmp_path / "bars")
    schema = "ticker string, date date, open double, high double, low double, close double, volume double"

    def put(*days):
        rows = [("a", day, 1.0, 1.0, 1.0, float(n), 1.0) for n, day in days]
        df = spark.createDataFrame(rows, schema.replace("date date", "date string")).withColumn("date", F.col("date").cast("date"))
        df.coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.02)

    put((1, "2024-01-01"), (2, "2024-01-03"))
    put((9, "2024-01-02"), (3, "2024-01-04"))
    source = sb.parquet_stream(spark, path, spark.read.parquet(path).schema, files_per_trigger=1)
    _, got = run(spark, si.ewm_stream(source), tmp_path, "late")
    assert [(str(r["date"]), r["late"]) for r in got.orderBy("date").collect()] == [
        ("2024-01-01", 0), ("2024-01-03", 0), ("2024-01-04", 1)
    ]
    put((5, "2024-01-09"), (6, "2024-01-09"))
    with pytest.raises(Exception, match="unique"):
        run(spark, si.ewm_stream(source), tmp_path, "twice")


def step_stream(spark, source, tmp_path, name, steps, **options):
    stream = StepStream(str(tmp_path / name), steps, **options)
    query = stream.run(source, str(tmp_path / f"{name}-checkpoint"), finish=True)
    return stream, query


STEP_COLUMNS = ["adx", "tmf_26w_min_dd", "signal", "previous_exit_success", "exit_gain_loss", "exit_date"]


@pytest.mark.parametrize("compact", [1, 3])
def test_any_steps_over_batches(spark, bars, yearly_files, tmp_path, compact):
    """The steps of the batch job with their look-back and look-ahead, with state compacted at different times."""
    source = sb.parquet_stream(spark, yearly_files, bars.schema, files_per_trigger=2)
    steps = [ind.tmf_signal(), tr.lagged_wins(), ind.adx()]
    stream, query = step_stream(spark, source, tmp_path, f"steps{compact}", steps, compact=compact)
    assert len([p for p in query.recentProgress if p["numInputRows"]]) >= 3
    got = stream.results(spark)
    assert got.count() == bars.count()
    equal(got, compute(bars, *steps), STEP_COLUMNS)
    kept = stream.state(spark, bars.schema).groupBy("ticker").count().agg(F.max("count")).first()[0]
    most = compact * bars.groupBy("ticker", F.year("date")).count().agg(F.max("count")).first()[0]
    assert kept <= stream.back + stream.ahead + 4 * most
    assert stream.late(spark, bars.drop("bar_index").schema).count() == 0


def test_steps_let_a_bar_out_when_what_it_looks_ahead_to_is_there(spark, tmp_path):
    """Late bars are kept apart, a repeated micro-batch changes nothing, the rest comes out at the end."""
    days = pd.date_range("2020-01-01", periods=40)
    rows = [(t, d.date(), float(i + t)) for t in (1, 2) for i, d in enumerate(days)]
    schema = "ticker bigint, date date, close double"
    ahead = Step("ahead", lambda w: [{"later": F.lead("close", 3).over(w), "before": F.lag("close", 5).over(w)}], back=5, ahead=3)
    stream = StepStream(str(tmp_path / "ahead"), [ahead], compact=2)
    frame = spark.createDataFrame(rows, schema)
    parts = [frame.where(F.dayofyear("date").between(a, b)) for a, b in ((1, 10), (11, 11), (12, 30), (31, 40))]
    for number, part in enumerate(parts):
        if number == 2:
            part = part.unionByName(spark.createDataFrame([(1, days[4].date(), 99.0)], schema))
        for _ in range(2):  # each micro-batch twice, as after a failure
            stream._write(part, number)
        upto = {0: 7, 1: 8, 2: 27, 3: 37}[number]
        assert stream.results(spark).count() == 2 * upto
    assert [r["close"] for r in stream.late(spark, frame.schema).collect()] == [99.0]
    stream._finish(frame)
    indexed = frame.withColumn("open", F.lit(1.0))
    equal(stream.results(spark), compute(index_bars(indexed), ahead), ["later", "before"])


def test_a_backtest_on_a_stream_gives_the_trades_of_the_stored_bars(spark, bars, yearly_files, tmp_path):
    test = live.smoothed_flow_test(bars)
    source = sb.parquet_stream(spark, yearly_files, bars.schema, files_per_trigger=2)
    got = test.run_stream(source, str(tmp_path / "test"), str(tmp_path / "test-checkpoint"))
    equal(got, test.run(), ["exit_date", "net_ratio", "allocation"])


def test_late_rows_of_another_query_do_not_end_the_wait():
    late = sb._LateRows()
    late.ended.add("other")
    assert late.of("own", 0.01) is None
    late.rows["own"] = 3
    late.ended.add("own")
    assert late.of("own", 0.01) == 3


def test_a_replay_that_is_written_twice_is_the_same(spark, bars, tmp_path):
    path = str(tmp_path / "again")
    for _ in range(2):
        sb.write_in_time_order(bars, path)
    assert spark.read.option("recursiveFileLookup", True).parquet(path).count() == bars.count()


def test_the_state_of_silent_instruments_ends(spark, tmp_path):
    """Ten thousand instruments, two thousand at a time: only those of the last days are kept."""
    schema = "ticker bigint, date date, close double"
    source = str(tmp_path / "many")
    for i in range(5):
        day = F.date_add(F.lit("2020-01-01").cast("date"), 30 * i)
        part = spark.range(2_000).select((F.col("id") + 2_000 * i).alias("ticker"), day.alias("date"), F.col("id").cast("double").alias("close"))
        part.coalesce(1).write.parquet(f"{source}/part-{i}")
    stream = sb.parquet_stream(spark, source, spark.createDataFrame([], schema).schema, files_per_trigger=1)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    checkpoint = str(tmp_path / "checkpoint")
    closed = idle.run_idle(stream, 5, "1 day", str(tmp_path / "out"), checkpoint)
    assert closed.count() == 8_000 and closed.where("n_bars = 1 and first_date = last_date").count() == 8_000
    assert idle.open_instruments(spark, checkpoint).count() == 2_000
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == before


def test_silence_between_and_inside_batches(spark, tmp_path):
    schema = "ticker bigint, date date, close double"
    days = [("2020-01-01", 3.0), ("2020-01-04", 1.0), ("2020-01-08", 2.0), ("2020-01-20", 9.0), ("2020-01-21", 8.0)]
    source = str(tmp_path / "few")
    for i, part in enumerate((days[:1], days[1:4], days[4:])):
        rows = [(7, pd.Timestamp(d).date(), c) for d, c in part]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{source}/part-{i}")
    stream = sb.parquet_stream(spark, source, spark.createDataFrame([], schema).schema, files_per_trigger=1)
    closed = idle.run_idle(stream, 3, "1 day", str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    found = sorted((str(r.first_date), str(r.last_date), r.n_bars, r.lowest, r.highest) for r in closed.collect())
    assert found == [("2020-01-01", "2020-01-04", 2, 1.0, 3.0), ("2020-01-08", "2020-01-08", 1, 2.0, 2.0)]
