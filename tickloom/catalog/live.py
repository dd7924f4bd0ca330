"""Streaming queries and the strategy interface."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.catalog import prediction  # its SQL is used again here
from tickloom.catalog import views as v
from tickloom.catalog.registry import ORACLES, query
from tickloom.catalog.sql import EXITS, OVER, ewm, fixed, last_rows, r, rs, rsi, sql, view
from tickloom.operators import features as feat
from tickloom.operators import indicators as ind
from tickloom.operators import strategy as st
from tickloom.operators import trades as tr
from tickloom.plans.steps import compute
from tickloom.sources import store
from tickloom.sources.bars import event_ticks
from tickloom.streaming import bars as sb
from tickloom.streaming import indicators as si
from tickloom.streaming.idle import run_idle
from tickloom.streaming.steps import StepStream

_RUNS = [0]
_REPLAYS: set[str] = set()
FILES_PER_TRIGGER, STEP_BATCHES = 16, 4


def fresh(spark: SparkSession, name: str) -> tuple[str, str]:
    """A new output folder and checkpoint below the shared folder."""
    _RUNS[0] += 1
    base = store.scratch(spark, "streams", f"{name}-{_RUNS[0]}")
    return f"{base}/out", f"{base}/checkpoint"


def stored(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    path, checkpoint = fresh(spark, name)
    sb.run_to_parquet(stream, path, checkpoint)
    return sb.read_batches(spark, path, stream.schema)


def tick_stream(spark: SparkSession, folder: str) -> DataFrame:
    schema = store.table(spark, folder, "events").schema
    return event_ticks(sb.parquet_stream(spark, folder, schema, "events.parquet"))


def bar_stream(spark: SparkSession, folder: str, batches: int | None = None) -> DataFrame:
    """The bars replayed as a stream of closed bars, in several micro-batches, or in so many at most."""
    bars = v.bars(spark, folder)
    path = store.scratch(spark, "replay", f"{store.tag(folder)}-{store.manifest(spark, folder)}")
    if path not in _REPLAYS:
        sb.write_in_time_order(bars, path)
        _REPLAYS.add(path)
    files = FILES_PER_TRIGGER
    if batches:
        files = -(-len(spark.read.option("recursiveFileLookup", True).parquet(path).inputFiles()) // batches)
    return sb.parquet_stream(spark, path, bars.schema, files_per_trigger=files)


CLOSED = "WHERE date + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)"


@query(
    "stream_bars",
    f"""
    SELECT ticker, date, open, high, low, close, volume FROM (
      SELECT event_type AS ticker, CAST(ts AS DATE) AS date,
             arg_min(value, row(ts, event_id)) AS open, max(value) AS high, min(value) AS low,
             arg_max(value, row(ts, event_id)) AS close, CAST(count(*) AS DOUBLE) AS volume
      FROM events GROUP BY 1, 2) {CLOSED}
    """,
)
def stream_bars(spark: SparkSession, folder: str) -> DataFrame:
    return stored(spark, sb.tumbling_bars(tick_stream(spark, folder)), "bars")


@query(
    "stream_bars_hourly",
    """
    SELECT * FROM (
      SELECT event_type AS ticker, date_trunc('hour', ts) AS date,
             arg_min(value, row(ts, event_id)) AS open, max(value) AS high, min(value) AS low,
             arg_max(value, row(ts, event_id)) AS close, CAST(count(*) AS DOUBLE) AS volume
      FROM events GROUP BY 1, 2)
    WHERE date + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)
    """,
)
def stream_bars_hourly(spark: SparkSession, folder: str) -> DataFrame:
    """Bars finer than a day keep the time at which they start."""
    return stored(spark, sb.tumbling_bars(tick_stream(spark, folder), width="1 hour"), "hourly")


@query(
    "stream_sliding_min",
    """
    SELECT event_type AS ticker, CAST(d - INTERVAL 28 DAY AS DATE) AS start_date, CAST(d AS DATE) AS end_date, min(value) AS min_price
    FROM events JOIN (SELECT unnest(generate_series(DATE '2023-12-01', DATE '2024-04-01', INTERVAL 1 DAY)) AS d)
      ON ts >= d - INTERVAL 28 DAY AND ts < d
    WHERE d <= (SELECT max(ts) - INTERVAL 1 DAY FROM events) GROUP BY 1, 2, 3
    """,
)
def stream_sliding_min(spark: SparkSession, folder: str) -> DataFrame:
    return stored(spark, sb.sliding_min(tick_stream(spark, folder)), "sliding_min")


@query(
    "stream_ewm",
    sql(
        f"""
        SELECT ticker, date, {rs('ema_close', 'tmf_w')}, {r(rsi('g', 'l'))} AS rsi_ewm FROM (
          SELECT *, {ewm('close', 13)} AS ema_close, {ewm('chg_gain', 13)} AS g, {ewm('chg_loss', 13)} AS l FROM (
          SELECT *, CASE WHEN close / open - 1 > 0 THEN close / open - 1 ELSE 0 END AS chg_gain,
                    CASE WHEN close / open - 1 <= 0 THEN close / open - 1 ELSE 0 END AS chg_loss FROM tmf))
        """,
        "tmf",
    ),
)
def stream_ewm(spark: SparkSession, folder: str) -> DataFrame:
    out = stored(spark, si.ewm_stream(bar_stream(spark, folder)), "ewm")
    return out.select("ticker", "date", v.r("ema_close"), v.r("tmf_w"), v.r("rsi_ewm"))


@query(
    "stream_signal",
    sql(f"SELECT ticker, date, signal, {rs('tmf_w', 'tmf_26w_min', 'tmf_26w_min_dd')} FROM sig", "sig"),
)
def stream_signal(spark: SparkSession, folder: str) -> DataFrame:
    out = stored(spark, si.signal_stream(bar_stream(spark, folder)), "signal")
    return v.by_bar(out, "signal", rounded=("tmf_w", "tmf_26w_min", "tmf_26w_min_dd"))


@query("stream_features", ORACLES["feature_table"])
def stream_features(spark: SparkSession, folder: str) -> DataFrame:
    """All model inputs on a stream: the steps of the batch job, in several micro-batches."""
    path, checkpoint = fresh(spark, "features")
    stream = StepStream(path, feat.feature_steps(), feat.signal_features)
    stream.run(bar_stream(spark, folder, STEP_BATCHES), checkpoint, finish=True)
    return prediction.shown_features(stream.results(spark))


SILENT_DAYS = 3


@query(
    "stream_idle",
    sql(
        f"""
        SELECT ticker, first_date, last_date, n_bars, lowest, highest FROM (
          SELECT ticker, g, min(date) AS first_date, max(date) AS last_date, count(*) AS n_bars, {r('min(close)')} AS lowest,
                 {r('max(close)')} AS highest, max(g) OVER (PARTITION BY ticker) AS last_g
          FROM (SELECT *, sum(jump) {OVER} AS g FROM (
            SELECT *, CASE WHEN datediff('day', lag(date) {OVER}, date) > {SILENT_DAYS} THEN 1 ELSE 0 END AS jump FROM idx))
          GROUP BY ticker, g)
        WHERE g < last_g OR datediff('day', last_date, (SELECT max(date) FROM idx)) > {SILENT_DAYS} + 366
        """,
        "idx",
    ),
)
def stream_idle(spark: SparkSession, folder: str) -> DataFrame:
    """Instruments silent for more than three days, closed by timers on event time or by their next bar."""
    path, checkpoint = fresh(spark, "idle")
    out = run_idle(bar_stream(spark, folder, STEP_BATCHES), SILENT_DAYS, "366 days", path, checkpoint)
    return out.select("ticker", "first_date", "last_date", "n_bars", v.r("lowest"), v.r("highest"))


# ---- strategy interface ------------------------------------------------------------------------------


@query(
    "indicator_dedup",
    sql(
        f"""
        SELECT ticker, date, {fixed('m')} AS macd, {fixed('m')} AS macd_again, {fixed('d')} AS macd_change FROM (
          SELECT *, m - lag(m) {OVER} AS d FROM (
          SELECT *, ({ewm('close', 11)}) - ({ewm('close', 25)}) AS m FROM idx))
        """,
        "idx",
    ),
)
def indicator_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """The same indicator asked for twice has one uid and is computed once."""
    test = st.Backtest()
    test.add_data(v.bars(spark, folder))

    def macd() -> str:
        fast = test.add_indicator(st.ewm_mean, ["close"], com=11)
        slow = test.add_indicator(st.ewm_mean, ["close"], com=25)
        return test.add_indicator(st.difference, [fast, slow])

    first, second = macd(), macd()
    moved = test.add_indicator(st.change, [first])
    out = test.frame([first, second, moved])
    names = {"macd": first, "macd_again": second, "macd_change": moved}
    return out.select("ticker", "date", *[v.fixed(F.col(u)).alias(n) for n, u in names.items()])


STRENGTH = "CASE WHEN signal = 1 THEN abs(lag(tmf_26w_min_dd) {0}) / abs(tmf_26w_min_dd_qtl_50) END"


@query(
    "signal_strength",
    sql(
        f"""
        SELECT ticker, date, {rs('strength')} FROM (
          SELECT *, {STRENGTH.format(OVER)} AS strength FROM
          (SELECT m.*, s.signal FROM medians m JOIN sig s USING (ticker, bar_index))) WHERE signal = 1
        """,
        "medians", "sig",
    ),
)
def signal_strength(spark: SparkSession, folder: str) -> DataFrame:
    out = compute(v.bars(spark, folder), ind.tmf_floor_medians(), tr.signal_strength())
    return v.by_bar(out.where(F.col("signal") == 1), rounded=("strength",))


@query(
    "allocation",
    sql(
        f"""
        SELECT ticker, date, {r('strength / sum(strength) OVER (PARTITION BY date)')} AS allocation FROM (
          SELECT *, {STRENGTH.format(OVER)} AS strength FROM
          (SELECT m.*, s.signal FROM medians m JOIN sig s USING (ticker, bar_index))) WHERE signal = 1
        """,
        "medians", "sig",
    ),
)
def allocation(spark: SparkSession, folder: str) -> DataFrame:
    out = compute(v.bars(spark, folder), ind.tmf_floor_medians(), tr.signal_strength())
    signals = out.where(F.col("signal") == 1).select("ticker", "date", "strength")
    return v.by_bar(st.allocate(signals, st.share_of_strength), rounded=("allocation",))


def smoothed_flow_test(bars: DataFrame) -> st.Backtest:
    """A strategy put together from indicator functions: the floor of a smoothed close turns flat."""
    test = st.Backtest()
    test.add_data(bars)
    smooth = test.add_indicator(st.ewm_mean, ["close"], com=13)
    floor = test.add_indicator(st.rolling_min, [smooth], count=130)
    fall = test.add_indicator(st.change, [floor])
    pulse = test.add_indicator(st.turns_flat, [fall])
    test.add_strategy(pulse)
    test.add_broker(tr.net_ratio)
    return test


FLAT = f"""
    SELECT *, CASE WHEN dd = 0 AND lag(dd) {OVER} < 0 THEN 1 ELSE 0 END AS signal FROM (
    SELECT *, lo - lag(lo) {OVER} AS dd FROM (
    SELECT *, min(e) {last_rows(130)} AS lo FROM (SELECT *, {ewm('close', 13)} AS e FROM idx)))
"""


view("test_signal", "idx", FLAT)
view("test_outcomes", "test_signal", EXITS.format("test_signal"))
view("test_trades", "test_outcomes", "SELECT * FROM test_outcomes WHERE signal = 1")


@query(
    "backtest_summary",
    sql(
        f"""
        SELECT year, CAST(sum(n) AS BIGINT) AS opportunities, CAST(sum(won) AS BIGINT) AS success,
               CAST(sum(lost) AS BIGINT) AS fail, {r('CAST(sum(won) AS DOUBLE) / CAST(sum(lost) AS DOUBLE)')} AS success_fail_ratio,
               {r('sum(mean * n) / CAST(sum(n) AS DOUBLE)')} AS avg_return_rate
        FROM (SELECT ticker, CAST(year(date) AS INTEGER) AS year, count(net) AS n, avg(net) AS mean,
                     count(*) FILTER (WHERE net > 1) AS won, count(*) FILTER (WHERE net < 1) AS lost
              FROM (SELECT *, exit_gain_loss - 0.002 AS net FROM test_trades) GROUP BY 1, 2) GROUP BY 1
        """,
        "test_trades",
    ),
)
def backtest_summary(spark: SparkSession, folder: str) -> DataFrame:
    test = smoothed_flow_test(v.bars(spark, folder))
    return summary(test, test.run())


def summary(test: st.Backtest, trades: DataFrame) -> DataFrame:
    return test.performance(trades).select(
        "year", "opportunities", "success", "fail", v.r("success_fail_ratio"), v.r("avg_return_rate")
    )


@query("stream_backtest", ORACLES["backtest_summary"])
def stream_backtest(spark: SparkSession, folder: str) -> DataFrame:
    """The same strategy and costs on a stream of closed bars."""
    test = smoothed_flow_test(v.bars(spark, folder))
    path, checkpoint = fresh(spark, "backtest")
    return summary(test, test.run_stream(bar_stream(spark, folder, STEP_BATCHES), path, checkpoint))


DAILY = 12_000.0
FEES = "2 * CASE WHEN capital > 10000 THEN 0.0005::DOUBLE ELSE 5.0::DOUBLE / capital END"


@query(
    "backtest_fees",
    sql(
        f"""
        SELECT ticker, date, {r('capital')} AS capital, {r(f'exit_gain_loss - {FEES}')} AS net_ratio
        FROM (SELECT *, {DAILY}::DOUBLE / count(*) OVER (PARTITION BY date) AS capital FROM test_trades)
        """,
        "test_trades",
    ),
)
def backtest_fees(spark: SparkSession, folder: str) -> DataFrame:
    """Fees by the size of a trade: a share of large ones, a fixed fee for small ones."""
    test = smoothed_flow_test(v.bars(spark, folder))
    test.capital, test.costs = DAILY, []
    test.add_broker(tr.fee_by_size())
    shown = v.single(F.col("allocation") * DAILY).alias("capital")
    return test.run().select("ticker", "date", shown, v.r("net_ratio"))


def days_cost(ratio: Column, trade: dict[str, Column]) -> Column:
    """What the money costs for the days a trade is open."""
    return ratio - (tr.funding_factor(trade["days"]) - 1)


FALL = """
    SELECT ticker, date, entry_date, exit_date, exit_gain_loss, '{0}' AS strategy FROM test_{0}_outcomes WHERE signal = 1
"""
for _name, _bars in (("slow", 130), ("quick", 20)):
    view(f"test_{_name}", "idx", FLAT.replace(last_rows(130), last_rows(_bars)))
    view(f"test_{_name}_outcomes", f"test_{_name}", EXITS.format(f"test_{_name}"))


@query(
    "backtest_two_strategies",
    sql(
        f"""
        SELECT strategy, ticker, date, {r('net')} AS net_ratio, {r('1.0 / count(*) OVER (PARTITION BY strategy, date)')} AS allocation
        FROM (SELECT *, exit_gain_loss - 0.002 - (pow(1 + 0.05 / 365, datediff('day', entry_date, exit_date)) - 1) AS net
              FROM ({FALL.format('slow')} UNION ALL {FALL.format('quick')}))
        """,
        "test_slow_outcomes", "test_quick_outcomes",
    ),
)
def backtest_two_strategies(spark: SparkSession, folder: str) -> DataFrame:
    """Two floors of one smoothed close, with commission and the cost of the days held."""
    test = st.Backtest()
    test.add_data(v.bars(spark, folder))
    smooth = test.add_indicator(st.ewm_mean, ["close"], com=13)
    names = {}
    for name, count in (("slow", 130), ("quick", 20)):
        fall = test.add_indicator(st.change, [test.add_indicator(st.rolling_min, [smooth], count=count)])
        names[test.add_strategy(test.add_indicator(st.turns_flat, [fall]))] = name
    test.add_broker(tr.net_ratio)
    test.add_broker(days_cost)
    out = test.run()
    label = F.lit(None).cast("string")
    for uid, name in names.items():
        label = F.when(F.col("strategy") == uid, name).otherwise(label)
    return out.select(label.alias("strategy"), "ticker", "date", v.r("net_ratio"), v.r("allocation"))
