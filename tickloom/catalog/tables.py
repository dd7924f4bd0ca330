"""Sources, sinks, projections, filters, sorting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.catalog import views as v
from tickloom.catalog.registry import query
from tickloom.catalog.sql import OVER, TYPICAL, last_rows, r, rs, sql
from tickloom.operators import features as feat
from tickloom.operators import indicators as ind
from tickloom.operators import reports, series
from tickloom.operators import trades as tr
from tickloom.operators.windows import rolling
from tickloom.sources import bars as src
from tickloom.sources import store

BAR = "ticker, date, open, high, low, close, volume"
BAR_COLUMNS = ["ticker", "date", "open", "high", "low", "close", "volume"]


# ---- sources and sinks -------------------------------------------------------------------


def stored_bars(spark: SparkSession, folder: str) -> str:
    """Bars in the stored layout: an older file set, a newer one that lacks some columns, and notes."""
    path = store.fresh(spark, "stored")
    named = v.bars(spark, folder).select(
        src.date_to_ns(F.col("date")).alias("Date"),
        F.col("ticker").cast("string").alias("Ticker"),
        *[F.col(c).alias(c.capitalize()) for c in ("close", "high", "low", "open", "volume")],
    )
    cut = src.date_to_ns(F.lit(v.SINCE).cast("date"))
    old = named.where(F.col("Date") < cut).withColumns(
        {"Adj Close": F.col("Close"), "Dividends": F.lit(0.0), "Stock Splits": F.lit(0.0)}
    )
    store.write_parquet(old, f"{path}/old")
    store.write_parquet(named.where(F.col("Date") >= cut), f"{path}/new")
    notes = spark.sql("SELECT 'split adjusted' AS note")
    store.write_csv(notes, f"{path}/notes")
    return path


TIDY_SQL = f"""
    SELECT date, CAST(ticker AS VARCHAR) AS ticker, close, high, low, open, volume,
           CASE WHEN date < DATE '{v.SINCE}' THEN close END AS adj_close,
           CASE WHEN date < DATE '{v.SINCE}' THEN 0.0::DOUBLE END AS dividends,
           CASE WHEN date < DATE '{v.SINCE}' THEN 0.0::DOUBLE END AS stock_splits
    FROM bars
"""


@query("scan_bars", sql(TIDY_SQL, "bars"))
def scan_bars(spark: SparkSession, folder: str) -> DataFrame:
    path = stored_bars(spark, folder)
    return src.tidy(src.scan_bars(spark, f"{path}/{{old,new}}"))


@query("scan_glob", sql(TIDY_SQL, "bars"))
def scan_glob(spark: SparkSession, folder: str) -> DataFrame:
    """The whole folder, in which the pattern leaves out the files of another kind."""
    return src.tidy(src.scan_bars(spark, stored_bars(spark, folder) + "/*", glob="*.parquet"))


@query(
    "epoch_ns_to_date",
    "SELECT o_orderkey, epoch_ns(CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP)) AS ns, "
    "CAST(o_orderdate AS DATE) AS date FROM orders",
)
def epoch_ns_to_date(spark: SparkSession, folder: str) -> DataFrame:
    ns = src.date_to_ns(F.col("o_orderdate").cast("date"))
    orders = store.table(spark, folder, "orders").select("o_orderkey", ns.alias("ns"))
    return orders.withColumn("date", src.ns_to_date(F.col("ns")))


@query("latest_csv", sql(f"SELECT {BAR} FROM bars WHERE date = (SELECT max(date) FROM bars)", "bars"))
def latest_csv(spark: SparkSession, folder: str) -> DataFrame:
    """A folder of many part files, to which the bars of the last day come as one file."""
    path = store.fresh(spark, "csv_parts")
    bars = v.bars(spark, folder).select(BAR_COLUMNS)
    newest = bars.agg(F.max("date")).first()[0]
    store.write_csv(bars.where(F.col("date") < newest), f"{path}/1")
    store.write_csv(bars.where(F.col("date") == newest).repartition(1), f"{path}/2")
    return store.read_latest_csv(spark, path, bars.schema)


@query("roundtrip_parquet", sql(f"SELECT {BAR}, CAST(year(date) AS INTEGER) AS year FROM bars WHERE date >= DATE '2000-01-01'", "bars"))
def roundtrip_parquet(spark: SparkSession, folder: str) -> DataFrame:
    path = store.fresh(spark, "roundtrip_parquet")
    subset = v.bars(spark, folder).where(F.col("date") >= "2000-01-01").select(BAR_COLUMNS)
    store.write_parquet(subset.withColumn("year", F.year("date")), path, ["year"])
    return spark.read.parquet(path)


@query("roundtrip_csv", sql(f"SELECT {BAR} FROM bars", "bars"))
def roundtrip_csv(spark: SparkSession, folder: str) -> DataFrame:
    path = store.fresh(spark, "roundtrip_csv")
    bars = v.bars(spark, folder).select(BAR_COLUMNS)
    store.write_csv(bars, path)
    return store.read_csv(spark, path, bars.schema)


@query("ohlcv_bars", sql(f"SELECT {BAR} FROM bars", "bars"))
def ohlcv_bars(spark: SparkSession, folder: str) -> DataFrame:
    return src.shipment_bars(store.table(spark, folder, "lineitem")).select(BAR_COLUMNS)


EVENT_BARS = """
    SELECT event_type AS ticker, CAST(ts AS DATE) AS date,
           arg_min(value, row(ts, event_id)) AS open, max(value) AS high, min(value) AS low,
           arg_max(value, row(ts, event_id)) AS close, CAST(count(*) AS DOUBLE) AS volume
    FROM events GROUP BY 1, 2
"""


@query("event_bars", EVENT_BARS)
def event_bars(spark: SparkSession, folder: str) -> DataFrame:
    return src.event_bars(v.ticks(spark, folder))


@query(
    "multi_feed",
    sql(
        f"""
        SELECT 'shipments' AS feed, CAST(ticker AS VARCHAR) AS ticker, date, open, high, low, close, volume FROM bars
        UNION ALL
        SELECT 'events', ticker, date, open, high, low, close, NULL FROM ({EVENT_BARS})
        """,
        "bars",
    ),
)
def multi_feed(spark: SparkSession, folder: str) -> DataFrame:
    shipments = v.bars(spark, folder).select(BAR_COLUMNS)
    shipments = shipments.withColumn("ticker", F.col("ticker").cast("string"))
    events = src.event_bars(v.ticks(spark, folder)).drop("volume")
    return src.union_feeds({"shipments": shipments, "events": events})


# ---- projections and filters -----------------------------------------------------------------


@query(
    "entry_price",
    sql(f"SELECT ticker, date, {TYPICAL} AS entry_price, lead({TYPICAL}) {OVER} AS next_entry_price FROM idx", "idx"),
)
def entry_price(spark: SparkSession, folder: str) -> DataFrame:
    out = v.on_bars(spark, folder, tr.next_entry()).withColumn("entry_price", tr.typical_price())
    return v.by_bar(out, "entry_price", "next_entry_price")


@query("capital_traded", sql("SELECT ticker, date, cap_xchgd_approx FROM caps", "caps"))
def capital_traded(spark: SparkSession, folder: str) -> DataFrame:
    bars = v.bars(spark, folder)
    for added in ind.capital_traded().layers(None):
        bars = bars.withColumns(added)
    return v.by_bar(bars, "cap_xchgd_approx")


@query("gain_loss_split", sql("SELECT ticker, date, chg, gain, loss FROM chg", "chg"))
def gain_loss_split(spark: SparkSession, folder: str) -> DataFrame:
    bars = v.bars(spark, folder)
    for added in ind.change_split().layers(None):
        bars = bars.withColumns(added)
    return v.by_bar(bars, "chg", "gain", "loss")


@query("slip_price", sql("SELECT ticker, date, (high + low) / 2 AS slip_price FROM bars", "bars"))
def slip_price(spark: SparkSession, folder: str) -> DataFrame:
    return v.bars(spark, folder).select(
        "ticker", "date", ((F.col("high") + F.col("low")) / 2).alias("slip_price")
    )


@query("filter_signal", sql(f"SELECT ticker, date, {rs('tmf_w')} FROM trades WHERE date >= DATE '{v.SINCE}'", "trades"))
def filter_signal(spark: SparkSession, folder: str) -> DataFrame:
    out = v.on_bars(spark, folder, ind.tmf_signal())
    kept = out.where((F.col("signal") == 1) & (F.col("date") >= v.SINCE))
    return v.by_bar(kept, rounded=("tmf_w",))


SPLIT_SQL = """CASE WHEN year(date) IN (1995, 1996, 1997, 1998) THEN 'train'
    WHEN year(date) IN (1999, 2000) THEN 'validate' WHEN year(date) IN (2001) THEN 'test' END"""


@query("time_split", sql(f"SELECT ticker, date, {SPLIT_SQL} AS split FROM bars", "bars"))
def time_split(spark: SparkSession, folder: str) -> DataFrame:
    return feat.with_split(v.bars(spark, folder), v.SPLIT).select("ticker", "date", "split")


COMPLETE = " AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in [*feat.FEATURES, "target"])


@query(
    "dropna_features",
    sql(f"SELECT ticker, date, {rs(*feat.FEATURES, 'target')} FROM features WHERE {COMPLETE}", "features"),
)
def dropna_features(spark: SparkSession, folder: str) -> DataFrame:
    rows = feat.complete(v.features(spark, folder))
    return v.by_bar(rows, rounded=(*feat.FEATURES, "target"))


@query(
    "feature_target",
    sql(f"SELECT {rs(*feat.FEATURES, 'target')} FROM features", "features"),
)
def feature_target(spark: SparkSession, folder: str) -> DataFrame:
    rows = v.features(spark, folder).drop("ticker", "date", "exit_gain_loss")
    return rows.select(*[v.r(c) for c in (*feat.FEATURES, "target")])


@query(
    "log_features",
    sql(
        f"SELECT ticker, date, {rs('log_vol', 'log_cap')}, "
        f"{r('log10(yearly_cap_xchngd + 100)')} AS log_year_cap FROM caps",
        "caps",
    ),
)
def log_features(spark: SparkSession, folder: str) -> DataFrame:
    out = v.on_bars(spark, folder, ind.yearly_capital())
    out = out.withColumn("log_year_cap", F.log10(F.col("yearly_cap_xchngd") + 100))
    return v.by_bar(out, rounded=("log_vol", "log_cap", "log_year_cap"))


@query(
    "calendar_parts",
    sql(
        "SELECT ticker, date, year(date) AS year, dayofweek(date) AS day_of_week, "
        "CAST(date_trunc('month', date) AS DATE) AS month_start FROM bars",
        "bars",
    ),
)
def calendar_parts(spark: SparkSession, folder: str) -> DataFrame:
    return v.bars(spark, folder).select(
        "ticker",
        "date",
        F.year("date").cast("bigint").alias("year"),
        (F.dayofweek("date") - 1).cast("bigint").alias("day_of_week"),
        F.trunc("date", "month").alias("month_start"),
    )


BIN_SQL = """CASE WHEN win_loss_ratio < 1 THEN 'less than 1'
    WHEN win_loss_ratio < 2 THEN 'less than 2' ELSE 'more than 2' END"""


@query("ratio_bins", sql(f"SELECT ticker, year, {BIN_SQL} AS category FROM ratios", "ratios"))
def ratio_bins(spark: SparkSession, folder: str) -> DataFrame:
    years = reports.with_win_loss(v.trade_year(spark, folder))
    return years.select("ticker", "year", reports.ratio_bin(F.col("win_loss_ratio")).alias("category"))


@query("horizontal_minmax", sql("SELECT ticker, date, trh, trl FROM flow", "flow"))
def horizontal_minmax(spark: SparkSession, folder: str) -> DataFrame:
    return v.by_bar(v.on_bars(spark, folder, ind.accum_dist()), "trh", "trl")


@query(
    "unpivot_series",
    sql(
        f"""
        SELECT ticker, date, variable, {r('value')} AS value FROM (
          UNPIVOT (SELECT ticker, date, close, avg(close) {last_rows(12)} AS ma_fast,
                          avg(close) {last_rows(26)} AS ma_slow FROM idx)
          ON close, ma_fast, ma_slow INTO NAME variable VALUE value)
        """,
        "idx",
    ),
)
def unpivot_series(spark: SparkSession, folder: str) -> DataFrame:
    out = v.on_bars(
        spark, folder, rolling("close", 12, F.avg, "ma_fast"), rolling("close", 26, F.avg, "ma_slow")
    )
    long = reports.unpivot(out, ["ticker", "date"], ["close", "ma_fast", "ma_slow"])
    return long.withColumn("value", v.single(F.col("value")))


# ---- sorting and limiting ----------------------------------------------------------------------


@query("sorted_bars", sql("SELECT date, ticker, close FROM bars ORDER BY date, ticker", "bars"))
def sorted_bars(spark: SparkSession, folder: str) -> DataFrame:
    return v.bars(spark, folder).select("date", "ticker", "close").orderBy("date", "ticker")


@query(
    "series_slice",
    sql(
        """
        SELECT ticker, date, close, part FROM (
          SELECT *, 'inner' AS part, bar_index - 1 AS i, count(*) OVER (PARTITION BY ticker) AS n FROM idx) WHERE i >= 100 AND i < n - 1
        UNION ALL
        SELECT ticker, date, close, part FROM (
          SELECT *, 'tail' AS part, bar_index - 1 AS i, count(*) OVER (PARTITION BY ticker) AS n FROM idx) WHERE i >= greatest(n - 500, 0) AND i < n - 100
        """,
        "idx",
    ),
)
def series_slice(spark: SparkSession, folder: str) -> DataFrame:
    bars = v.bars(spark, folder)
    inner = series.positional_slice(bars, 100, -1).withColumn("part", F.lit("inner"))
    tail = series.positional_slice(bars, -500, -100).withColumn("part", F.lit("tail"))
    return inner.unionByName(tail).select("ticker", "date", "close", "part")


@query(
    "topk_per_year",
    sql(
        f"""
        SELECT ticker, year, {rs('win_loss_ratio')}, drnk FROM (
          SELECT *, dense_rank() OVER (PARTITION BY year ORDER BY win_loss_ratio DESC) AS drnk FROM ratios)
        WHERE drnk < 10
        """,
        "ratios",
    ),
)
def topk_per_year(spark: SparkSession, folder: str) -> DataFrame:
    top = reports.top_by_year(v.trade_year(spark, folder), 10)
    return top.select("ticker", "year", v.r("win_loss_ratio"), F.col("drnk").cast("bigint").alias("drnk"))
