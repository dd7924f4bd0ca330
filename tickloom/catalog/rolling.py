"""Window functions, smoothing and arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.catalog import views as v
from tickloom.catalog.registry import query
from tickloom.catalog.sql import OVER, ewm, frame, last_rows, r, rs, sql, truncated
from tickloom.functions import arrays as arr
from tickloom.functions.smoothing import Smoothing, lookback_of
from tickloom.operators import indicators as ind
from tickloom.operators import reports, series, windows
from tickloom.operators import trades as tr
from tickloom.plans.layout import index_bars, rows
from tickloom.plans.scan import SUM, running
from tickloom.plans.steps import Quantile, Step

# ---- ranks, shifts, frames -----------------------------------------------------------------


@query("bar_index", sql("SELECT ticker, date, bar_index FROM idx", "idx"))
def bar_index(spark: SparkSession, folder: str) -> DataFrame:
    return index_bars(v.plain_bars(spark, folder)).select("ticker", "date", "bar_index")


@query(
    "lag_lead",
    sql(f"SELECT ticker, date, lag(close) {OVER} AS close_lag, lead(close) {OVER} AS close_lead FROM idx", "idx"),
)
def lag_lead(spark: SparkSession, folder: str) -> DataFrame:
    return v.by_bar(v.on_bars(spark, folder, windows.lag_lead("close")), "close_lag", "close_lead")


@query(
    "rolling_min",
    sql(
        f"SELECT ticker, date, min(close) {last_rows(20)} AS min_20, min(close) {last_rows(130)} AS min_130 FROM idx",
        "idx",
    ),
)
def rolling_min(spark: SparkSession, folder: str) -> DataFrame:
    out = v.on_bars(
        spark, folder,
        windows.rolling("close", 20, F.min, "min_20"), windows.rolling("close", 130, F.min, "min_130"),
    )
    return v.by_bar(out, "min_20", "min_130")


@query(
    "rolling_minmax_full",
    sql(
        f"""
        SELECT ticker, date, CASE WHEN bar_index >= 14 THEN min(low) {last_rows(14)} END AS min_14,
               CASE WHEN bar_index >= 14 THEN max(high) {last_rows(14)} END AS max_14 FROM idx
        """,
        "idx",
    ),
)
def rolling_minmax_full(spark: SparkSession, folder: str) -> DataFrame:
    out = v.on_bars(
        spark, folder,
        windows.rolling_full("low", 14, F.min, "min_14"), windows.rolling_full("high", 14, F.max, "max_14"),
    )
    return v.by_bar(out, "min_14", "max_14")


@query("rolling_mean", sql(f"SELECT ticker, date, {r(f'avg(close) {last_rows(14)}')} AS mean_14 FROM idx", "idx"))
def rolling_mean(spark: SparkSession, folder: str) -> DataFrame:
    out = v.on_bars(spark, folder, windows.rolling("close", 14, F.avg, "mean_14"))
    return v.by_bar(out, rounded=("mean_14",))


@query(
    "rolling_min_range",
    sql(
        """
        SELECT ticker, date,
          min(close) OVER (PARTITION BY ticker ORDER BY date RANGE BETWEEN INTERVAL 27 DAY PRECEDING AND CURRENT ROW) AS min_28d,
          min(close) OVER (PARTITION BY ticker ORDER BY date RANGE BETWEEN INTERVAL 181 DAY PRECEDING AND CURRENT ROW) AS min_182d
        FROM bars
        """,
        "bars",
    ),
)
def rolling_min_range(spark: SparkSession, folder: str) -> DataFrame:
    frames = {"min_28d": (F.min, "close", 28), "min_182d": (F.min, "close", 182)}
    return v.by_bar(windows.calendar_rolling(v.bars(spark, folder), frames), *frames)


FALL = "CASE WHEN chg < 0 THEN chg END"


@query(
    "rolling_median_linear",
    sql(
        f"""
        SELECT ticker, date, {r(f'quantile_cont({FALL}, 0.5) {last_rows(20)}')} AS median_20,
               {r(f'quantile_cont({FALL}, 0.5) {last_rows(130)}')} AS median_130 FROM chg
        """,
        "chg",
    ),
)
def rolling_median_linear(spark: SparkSession, folder: str) -> DataFrame:
    out = v.on_bars(spark, folder, falls_median(20, "linear"), falls_median(130, "linear"))
    return v.by_bar(out, rounded=("median_20", "median_130"))


def falls_median(count: int, kind: str) -> Step:
    """Median of the falling bars' changes among the last ``count`` bars."""
    fall = F.when(F.col("chg") < 0, F.col("chg"))
    median = Quantile(f"median_{count}", fall, count, 0.5, kind)
    return windows.rolling_quantiles(f"falls_median:{count}:{kind}", median, needs=(ind.change_split(),))


NEAREST = f"list_sort(list(chg) FILTER (WHERE chg < 0) {last_rows(20)})"


@query(
    "rolling_median_nearest",
    sql(f"SELECT ticker, date, {NEAREST}[len({NEAREST}) // 2 + 1] AS median_20 FROM chg", "chg"),
)
def rolling_median_nearest(spark: SparkSession, folder: str) -> DataFrame:
    return v.by_bar(v.on_bars(spark, folder, falls_median(20, "nearest")), "median_20")


@query(
    "rolling_median_approx",
    sql(f"SELECT ticker, date, quantile_disc({FALL}, 0.5) {last_rows(521)} AS median_521 FROM chg", "chg"),
)
def rolling_median_approx(spark: SparkSession, folder: str) -> DataFrame:
    return v.by_bar(v.on_bars(spark, folder, falls_median(521, "lower")), "median_521")


QUARTILES = {"q1": 0.25, "q2": 0.5, "q3": 0.75}


@query(
    "rolling_quartiles",
    sql(
        "SELECT ticker, date, "
        + ", ".join(
            f"{r(f'quantile_cont(close, {q}) {last_rows(n)}')} AS {name}_{n}, "
            f"quantile_disc(close, {q}) {last_rows(n)} AS {name}_{n}_low"
            for n in (20, 521) for name, q in QUARTILES.items()
        )
        + " FROM idx",
        "idx",
    ),
)
def rolling_quartiles(spark: SparkSession, folder: str) -> DataFrame:
    """Three quartiles of two frames, each interpolated and as a value of the frame, from one pass."""
    wanted = [
        Quantile(f"{name}_{n}{mark}", F.col("close"), n, q, kind)
        for n in (20, 521) for name, q in QUARTILES.items() for mark, kind in (("", "linear"), ("_low", "lower"))
    ]
    out = v.on_bars(spark, folder, windows.rolling_quantiles("quartiles", *wanted))
    names = [w.out for w in wanted]
    return v.by_bar(
        out, *[n for n in names if n.endswith("_low")], rounded=tuple(n for n in names if not n.endswith("_low"))
    )


@query(
    "yearly_capital",
    sql(f"SELECT ticker, date, {rs('yearly_cap_xchngd')} FROM caps", "caps"),
)
def yearly_capital(spark: SparkSession, folder: str) -> DataFrame:
    out = v.on_bars(spark, folder, ind.yearly_capital())
    return v.by_bar(out, rounded=("yearly_cap_xchngd",))


@query("rolling_stddev", sql(f"SELECT ticker, date, {rs('std_vol', 'std_cap')} FROM caps", "caps"))
def rolling_stddev(spark: SparkSession, folder: str) -> DataFrame:
    return v.by_bar(v.on_bars(spark, folder, ind.yearly_capital()), rounded=("std_vol", "std_cap"))


@query(
    "lagged_win_count",
    sql("SELECT ticker, date, previous_exit_success, previous_exit_fail FROM past", "past"),
)
def lagged_win_count(spark: SparkSession, folder: str) -> DataFrame:
    out = v.on_bars(spark, folder, tr.lagged_wins())
    return v.by_bar(out, "previous_exit_success", "previous_exit_fail")


@query("first_diff", sql(f"SELECT ticker, date, close - lag(close) {OVER} AS close_diff FROM idx", "idx"))
def first_diff(spark: SparkSession, folder: str) -> DataFrame:
    diff = Step("diff", lambda w: [{"close_diff": F.col("close") - F.lag("close").over(w)}], back=1)
    return v.by_bar(v.on_bars(spark, folder, diff), "close_diff")


@query(
    "cumulative_return",
    sql(
        f"""
        SELECT ticker, date, {r('product(exit_gain_loss) OVER (PARTITION BY ticker ORDER BY date)')} AS cumulative_return
        FROM trades WHERE exit_gain_loss IS NOT NULL
        """,
        "trades",
    ),
)
def cumulative_return(spark: SparkSession, folder: str) -> DataFrame:
    numbered = reports.numbered_trades(v.trades(spark, folder))
    return v.by_bar(series.cumulative_return(numbered), rounded=("cumulative_return",))


@query(
    "running_volume",
    sql("SELECT ticker, date, sum(volume) OVER (PARTITION BY ticker ORDER BY date) AS running_volume FROM bars", "bars"),
)
def running_volume(spark: SparkSession, folder: str) -> DataFrame:
    out = running(v.bars(spark, folder), F.col("volume"), "running_volume", SUM)
    return v.by_bar(out, "running_volume")


@query(
    "expanding_list",
    sql(
        f"""
        SELECT ticker, date, len(l) AS size, {r('list_sum(l)')} AS total, l[1] AS first_close, l[-1] AS last_close
        FROM (SELECT ticker, date, list(close) OVER (PARTITION BY ticker, year(date), month(date) ORDER BY date) AS l FROM bars)
        """,
        "bars",
    ),
)
def expanding_list(spark: SparkSession, folder: str) -> DataFrame:
    bars = v.bars(spark, folder).withColumn("month", F.trunc("date", "month"))
    out = windows.expanding_list(bars, ["ticker", "month"], "date", "close", "closes")
    return out.select(
        "ticker", "date",
        F.size("closes").cast("bigint").alias("size"),
        v.single(arr.fold(F.col("closes"))).alias("total"),
        F.get("closes", F.lit(0)).alias("first_close"),
        F.element_at("closes", -1).alias("last_close"),
    )


@query(
    "rolling_selfjoin_equiv",
    sql(
        f"""
        SELECT a.ticker, a.date, {r('min(b.tmf_w)')} AS tmf_4w_min, {r('avg(b.close)')} AS mean_20
        FROM tmf a JOIN tmf b ON a.ticker = b.ticker AND b.bar_index BETWEEN a.bar_index - 19 AND a.bar_index
        GROUP BY 1, 2
        """,
        "tmf",
    ),
)
def rolling_selfjoin_equiv(spark: SparkSession, folder: str) -> DataFrame:
    """The join of a rolling aggregate back on (date, ticker), as a window without any join."""
    out = v.on_bars(
        spark, folder,
        windows.rolling("tmf_w", 20, F.min, "tmf_4w_min", (ind.tmf(),)),
        windows.rolling("close", 20, F.avg, "mean_20"),
    )
    return v.by_bar(out, rounded=("tmf_4w_min", "mean_20"))


# ---- smoothing ---------------------------------------------------------------------------------


@query(
    "ewm_wilder",
    sql(
        f"""
        SELECT ticker, date, {r(ewm('close', 11))} AS ema_12, {r(ewm('close', 25))} AS ema_26,
               {r(ewm('volume', 13))} AS ema_volume,
               {r(ewm('CASE WHEN volume > 20 THEN close END', 13))} AS ema_busy
        FROM idx
        """,
        "idx",
    ),
)
def ewm_wilder(spark: SparkSession, folder: str) -> DataFrame:
    busy = Step("busy", lambda w: [{"busy": F.when(F.col("volume") > 20, F.col("close"))}])
    out = v.on_bars(
        spark, folder,
        ind.ewm("close", 11, "ema_12"), ind.ewm("close", 25, "ema_26"),
        ind.ewm("volume", 13, "ema_volume"), ind.ewm("busy", 13, "ema_busy", (busy,)),
    )
    return v.by_bar(out, rounded=("ema_12", "ema_26", "ema_volume", "ema_busy"))


TRUNCATED = f"""
    SELECT ticker, date, {r(truncated('close', 12, 'standard'))} AS ema_12,
           {r(truncated('volume', 14, 'wilder'))} AS ema_volume FROM idx
"""


@query("ema_truncated", sql(TRUNCATED, "idx"))
def ema_truncated(spark: SparkSession, folder: str) -> DataFrame:
    out = v.on_bars(
        spark, folder,
        ind.ema_truncated("close", 12, "standard", "ema_12"),
        ind.ema_truncated("volume", 14, "wilder", "ema_volume"),
    )
    return v.by_bar(out, rounded=("ema_12", "ema_volume"))


@query("ema_truncated_fold", sql(TRUNCATED, "idx"))
def ema_truncated_fold(spark: SparkSession, folder: str) -> DataFrame:
    out = v.on_bars(
        spark, folder,
        ind.ema_truncated_fold("close", 12, "standard", "ema_12"),
        ind.ema_truncated_fold("volume", 14, "wilder", "ema_volume"),
    )
    return v.by_bar(out, rounded=("ema_12", "ema_volume"))


@query("ema_lag_sum", sql(f"SELECT ticker, date, {r(truncated('close', 5, 'standard'))} AS ema_5 FROM idx", "idx"))
def ema_lag_sum(spark: SparkSession, folder: str) -> DataFrame:
    out = v.on_bars(spark, folder, ind.ema_lag_sum("close", 5, "standard", "ema_5"))
    return v.by_bar(out, rounded=("ema_5",))


def mean_tail_sql(x: str, period: int, kind: str) -> str:
    s, back = Smoothing.of(period, kind), lookback_of(period, kind)
    values = f"list({x}) {frame(-(back - 1))}"
    head = (
        f"list_sum(list_transform({values}, lambda v, i: v * {s.weight!r} * pow({s.decay!r}, {back} - i)))"
    )
    return f"CASE WHEN len({values}) = {back} THEN {head} + {s.decay**back!r} * lag(m) {OVER} END"


@query(
    "ema_mean_tail",
    sql(
        f"""
        SELECT ticker, date, {r(mean_tail_sql('close', 5, 'standard'))} AS ema_5
        FROM (SELECT *, avg(close) {last_rows(6)} AS m FROM idx)
        """,
        "idx",
    ),
)
def ema_mean_tail(spark: SparkSession, folder: str) -> DataFrame:
    out = v.on_bars(spark, folder, ind.ema_mean_tail("close", 5, "standard", "ema_5"))
    return v.by_bar(out, rounded=("ema_5",))


# ---- arrays --------------------------------------------------------------------------------------


def lists(count: int) -> tuple[Step, Step]:
    """The last and the next ``count`` closes, the current one first or last."""
    return (
        Step("past", lambda w: [{"past": F.collect_list("close").over(rows(w, count))}], back=count - 1),
        Step(
            "coming",
            lambda w: [{"coming": F.collect_list("close").over(w.rowsBetween(1, count))}],
            ahead=count,
        ),
    )


PAST4, PAST5 = f"list(close) {last_rows(4)}", f"list(close) {last_rows(5)}"
COMING = f"list(close) {frame(1, 5)}"


@query(
    "array_transform_idx",
    sql(
        f"""
        SELECT ticker, date, pos, value FROM (
          SELECT ticker, date, unnest(range(len(l))) AS pos,
                 unnest(list_transform(l, lambda x, i: x * pow(0.5, len(l) - i))) AS value
          FROM (SELECT ticker, date, {PAST4} AS l FROM idx))
        """,
        "idx",
    ),
)
def array_transform_idx(spark: SparkSession, folder: str) -> DataFrame:
    out = v.on_bars(spark, folder, lists(4)[0])
    long = out.select("ticker", "date", F.posexplode(arr.weighted(F.col("past"), 0.5)).alias("pos", "value"))
    return long.withColumn("pos", F.col("pos").cast("bigint"))


@query(
    "array_fold",
    sql(
        f"SELECT ticker, date, {r('list_sum(l) * 0.5')} AS folded FROM (SELECT ticker, date, {PAST5} AS l FROM idx)",
        "idx",
    ),
)
def array_fold(spark: SparkSession, folder: str) -> DataFrame:
    out = v.on_bars(spark, folder, lists(5)[0]).withColumn("folded", arr.fold(F.col("past"), 0.5))
    return v.by_bar(out, rounded=("folded",))


def _arrays(name: str, body: str):
    return query(name, sql(f"SELECT ticker, date, {body} FROM (SELECT *, {COMING} AS l FROM idx)", "idx"))


@_arrays("array_first_hit", "CAST(list_position(list_transform(l, lambda x: x / close > 1.02), true) - 1 AS BIGINT) AS first_hit")
def array_first_hit(spark: SparkSession, folder: str) -> DataFrame:
    out = v.on_bars(spark, folder, lists(5)[1])
    hit = arr.first_place(F.col("coming"), lambda x: x / F.col("close") > 1.02)
    return v.by_bar(out.withColumn("first_hit", hit), "first_hit")


@_arrays("array_get", "l[CAST(volume AS BIGINT) % 5 + 1] AS picked")
def array_get(spark: SparkSession, folder: str) -> DataFrame:
    out = v.on_bars(spark, folder, lists(5)[1])
    place = (F.col("volume").cast("bigint") % 5).cast("int")
    return v.by_bar(out.withColumn("picked", F.get("coming", place)), "picked")


@_arrays("array_argmax", "CAST(list_position(l, list_max(l)) - 1 AS BIGINT) AS arg_max, coalesce(len(l), 0) AS size")
def array_argmax(spark: SparkSession, folder: str) -> DataFrame:
    out = v.on_bars(spark, folder, lists(5)[1])
    out = out.withColumns(
        {"arg_max": arr.arg_max(F.col("coming")), "size": F.size("coming").cast("bigint")}
    )
    return v.by_bar(out, "arg_max", "size")


@_arrays("array_forall", "coalesce(len(list_filter(l, lambda x: x <= 98)), 0) = 0 AS all_above")
def array_forall(spark: SparkSession, folder: str) -> DataFrame:
    out = v.on_bars(spark, folder, lists(5)[1])
    return v.by_bar(out.withColumn("all_above", arr.all_above(F.col("coming"), 98)), "all_above")
