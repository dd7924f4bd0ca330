"""Queries over a few long series, which run over many blocks: one bar per order line.

The daily bars of the given tables are shorter than a block. Here the lines of one number make an
instrument (thousands of bars in the small tables), in the order of their orders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.catalog import views as v
from tickloom.catalog.registry import query
from tickloom.catalog.sql import ewm, last_rows, r, rs, sql, truncated
from tickloom.operators import indicators as ind
from tickloom.operators import series, windows
from tickloom.operators import trades as tr
from tickloom.plans.layout import BLOCK_ROWS, POSITION, index_bars
from tickloom.plans.scan import SUM, dense_rank_by, running
from tickloom.plans.steps import Quantile, compute
from tickloom.sources.store import layer, table

LINE_ORDER = ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax"]
BARS = f"""
    SELECT concat('line ', l_linenumber) AS ticker,
           DATE '1900-01-01' + CAST(l_orderkey * 16 - 1 + row_number() OVER
             (PARTITION BY l_linenumber, l_orderkey ORDER BY {', '.join(LINE_ORDER)}) AS INTEGER) AS date,
           p AS open, p * (1 + l_tax / 10) AS high, p * (1 - l_discount / 10) AS low,
           p * (1 + (l_tax - l_discount) / 10) AS close, l_quantity AS volume
    FROM (SELECT *, 100 * (1 + (l_extendedprice - 50000) / 1e6) AS p FROM lineitem)
"""


ORDER_DAYS, RUN_ORDERS = 16, 64


def long_bars(spark: SparkSession, folder: str) -> DataFrame:
    """Numbered bars of the order lines; the lines of one order are few.

    The lines of a number and a run of orders are brought together once, and ordered and numbered there.
    """
    of_order = Window.partitionBy("ticker", "_span", "l_orderkey").orderBy(*LINE_ORDER)
    price = 100 * (1 + (F.col("l_extendedprice") - 50000) / 1e6)
    key, place = F.col("l_orderkey"), F.row_number().over(of_order)
    # the days of an order that go on into the next run of orders would be taken twice
    over = (F.col("place") > ORDER_DAYS) & (F.pmod(key, F.lit(RUN_ORDERS)) == RUN_ORDERS - 1)
    taken = F.raise_error(F.lit("bars must be unique by (ticker, date)")).cast("int")
    day = F.when(over, taken).otherwise((key * ORDER_DAYS - 1 + F.col("place")).cast("int"))

    lines = table(spark, folder, "lineitem").withColumns(
        {"ticker": F.concat(F.lit("line "), F.col("l_linenumber")), "_span": F.floor(key / RUN_ORDERS)}
    )

    def build() -> DataFrame:
        placed = lines.repartition("ticker", "_span").withColumns({"place": place, "p": price})
        return placed.select(
            "ticker",
            F.date_add(F.lit("1900-01-01").cast("date"), day).alias("date"),
            F.col("p").alias("open"),
            (F.col("p") * (1 + F.col("l_tax") / 10)).alias("high"),
            (F.col("p") * (1 - F.col("l_discount") / 10)).alias("low"),
            (F.col("p") * (1 + (F.col("l_tax") - F.col("l_discount")) / 10)).alias("close"),
            F.col("l_quantity").alias("volume"),
            "_span",
        )

    # a bar for each line, so that the lines are counted where they are read
    counts = lines.groupBy("ticker", "_span").agg(F.count(F.lit(1)).alias("_bars")).repartition("ticker")
    return layer(spark, folder, "long_bars", lambda: index_bars(build(), span=F.col("_span"), counts=counts))


def long_trades(spark: SparkSession, folder: str) -> DataFrame:
    out = compute(long_bars(spark, folder), ind.tmf_signal(), tr.first_hit_exit())
    return out.where("signal = 1").withColumn("exit_bar", F.col(POSITION) + 1 + F.col("exit_point"))


def long_sql(body: str, *views: str, recursive: bool = False) -> str:
    return sql(body, *views, recursive=recursive, instead={"bars": BARS})


def by_place(df: DataFrame, *exact: str, rounded: tuple[str, ...] = ()) -> DataFrame:
    return df.select("ticker", POSITION, *exact, *[v.r(c) for c in rounded])


@query(
    "long_ewm",
    long_sql(
        f"""
        SELECT ticker, bar_index, {r(ewm('close', 13))} AS ema_14, {r(ewm('volume', 40))} AS ema_volume FROM idx
        """,
        "idx",
    ),
)
def long_ewm(spark: SparkSession, folder: str) -> DataFrame:
    steps = ind.ewm("close", 13, "ema_14"), ind.ewm("volume", 40, "ema_volume")
    return by_place(compute(long_bars(spark, folder), *steps), rounded=("ema_14", "ema_volume"))


@query(
    "long_ema_truncated",
    long_sql(
        f"""
        SELECT ticker, bar_index, {r(truncated('close', 9, 'standard'))} AS ema_9,
               {r(truncated('volume', 14, 'wilder'))} AS ema_volume FROM idx
        """,
        "idx",
    ),
)
def long_ema_truncated(spark: SparkSession, folder: str) -> DataFrame:
    steps = (
        ind.ema_truncated("close", 9, "standard", "ema_9"),
        ind.ema_truncated("volume", 14, "wilder", "ema_volume"),
    )
    return by_place(compute(long_bars(spark, folder), *steps), rounded=("ema_9", "ema_volume"))


@query("long_tmf_signal", long_sql(f"SELECT ticker, bar_index, signal, {rs('tmf_w')} FROM sig", "sig"))
def long_tmf_signal(spark: SparkSession, folder: str) -> DataFrame:
    return by_place(compute(long_bars(spark, folder), ind.tmf_signal()), "signal", rounded=("tmf_w",))


@query(
    "long_exit",
    long_sql(
        f"SELECT ticker, bar_index, exit_point, exit_reason, {rs('exit_gain_loss')} FROM outcomes", "outcomes"
    ),
)
def long_exit(spark: SparkSession, folder: str) -> DataFrame:
    out = compute(long_bars(spark, folder), tr.first_hit_exit())
    return by_place(out, "exit_point", "exit_reason", rounded=("exit_gain_loss",))


@query(
    "long_nonoverlap",
    long_sql(
        """
        done AS MATERIALIZED (SELECT ticker, bar_index, exit_bar FROM trades WHERE exit_bar IS NOT NULL),
        following AS MATERIALIZED (SELECT a.ticker, a.bar_index, min(b.bar_index) AS next_bar
          FROM done a JOIN done b ON a.ticker = b.ticker AND b.bar_index >= a.exit_bar GROUP BY 1, 2),
        chain AS (
          SELECT ticker, min(bar_index) AS bar_index FROM done GROUP BY 1
          UNION ALL
          SELECT f.ticker, f.next_bar FROM chain c JOIN following f ON c.ticker = f.ticker AND c.bar_index = f.bar_index)
        SELECT d.ticker, d.bar_index, d.exit_bar, c.bar_index IS NOT NULL AS taken
        FROM done d LEFT JOIN chain c ON c.ticker = d.ticker AND c.bar_index = d.bar_index
        """,
        "trades", recursive=True,
    ),
)
def long_nonoverlap(spark: SparkSession, folder: str) -> DataFrame:
    return series.nonoverlapping(long_trades(spark, folder), longest=tr.ExitRule().hold + 2)


QUARTILES = {"q1": 0.25, "q2": 0.5, "q3": 0.75}
LONG_FRAME = 5000


@query(
    "long_quartiles",
    long_sql(
        "SELECT ticker, bar_index, "
        + ", ".join(f"quantile_disc(close, {q}) {last_rows(LONG_FRAME)} AS {name}" for name, q in QUARTILES.items())
        + " FROM idx",
        "idx",
    ),
)
def long_quartiles(spark: SparkSession, folder: str) -> DataFrame:
    """Frames longer than a block of the usual size."""
    wanted = [Quantile(name, F.col("close"), LONG_FRAME, q, "lower") for name, q in QUARTILES.items()]
    out = compute(long_bars(spark, folder), windows.rolling_quantiles("quartiles", *wanted))
    return by_place(out, *QUARTILES)


@query(
    "long_running",
    long_sql("SELECT ticker, bar_index, sum(volume) OVER (PARTITION BY ticker ORDER BY bar_index) AS running_volume FROM idx", "idx"),
)
def long_running(spark: SparkSession, folder: str) -> DataFrame:
    out = running(long_bars(spark, folder), F.col("volume"), "running_volume", SUM)
    return by_place(out, "running_volume")


@query(
    "long_rank",
    long_sql("SELECT ticker, bar_index, dense_rank() OVER (PARTITION BY ticker ORDER BY open DESC) AS drnk FROM idx", "idx"),
)
def long_rank(spark: SparkSession, folder: str) -> DataFrame:
    return by_place(dense_rank_by(long_bars(spark, folder), ["ticker"], "open", "drnk"), "drnk")


@query(
    "long_supertrend",
    long_sql(
        f"""
        basic AS MATERIALIZED (SELECT *, (high + low) / 2 + 2 * atr AS bu, (high + low) / 2 - 2 * atr AS bl FROM atrs),
        st AS (
          SELECT ticker, bar_index, close, bu AS ub, bl AS lb, 1 AS direction FROM basic WHERE bar_index = 1
          UNION ALL
          SELECT b.ticker, b.bar_index, b.close,
                 CASE WHEN b.bu < s.ub OR s.close > s.ub THEN b.bu ELSE s.ub END,
                 CASE WHEN b.bl > s.lb OR s.close < s.lb THEN b.bl ELSE s.lb END,
                 CASE WHEN b.close > s.ub THEN 1 WHEN b.close < s.lb THEN -1 ELSE s.direction END
          FROM st s JOIN basic b ON b.ticker = s.ticker AND b.bar_index = s.bar_index + 1)
        SELECT ticker, bar_index, {r('ub')} AS upperband, {r('lb')} AS lowerband, direction FROM st
        """,
        "atrs", recursive=True,
    ),
)
def long_supertrend(spark: SparkSession, folder: str) -> DataFrame:
    out = series.supertrend_recursive(compute(long_bars(spark, folder), ind.atr(), block=BLOCK_ROWS, blocks=True), 2)
    return by_place(out, "direction", rounded=("upperband", "lowerband"))
