"""Bar tables: scans with a declared schema, resampling of ticks, several feeds."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.numeric import idiv

DAY_NS = 86_400_000_000_000

# The columns of a stored bar file. Dates are nanoseconds since 1970.
BAR_FILE_SCHEMA = T.StructType(
    [
        T.StructField("Date", T.LongType()),
        T.StructField("Ticker", T.StringType()),
        T.StructField("Adj Close", T.DoubleType()),
        T.StructField("Close", T.DoubleType()),
        T.StructField("Dividends", T.DoubleType()),
        T.StructField("High", T.DoubleType()),
        T.StructField("Low", T.DoubleType()),
        T.StructField("Open", T.DoubleType()),
        T.StructField("Stock Splits", T.DoubleType()),
        T.StructField("Volume", T.DoubleType()),
    ]
)


def ns_to_date(ns: Column) -> Column:
    """Nanoseconds since 1970 to a date; whole-number arithmetic, so no time zone comes in."""
    into_day = F.pmod(ns, F.lit(DAY_NS).cast("bigint"))
    return F.date_from_unix_date(idiv(ns - into_day, DAY_NS).cast("int"))


def date_to_ns(date: Column) -> Column:
    return F.unix_date(date).cast("bigint") * F.lit(DAY_NS).cast("bigint")


def scan_bars(
    spark: SparkSession, path: str, schema: T.StructType = BAR_FILE_SCHEMA, glob: str | None = None
) -> DataFrame:
    """Scan a folder of bar files. Columns absent from a file come back as NULL.

    Files written with nanosecond timestamps are read as whole numbers, which Spark does
    only with the setting below.
    """
    spark.conf.set("spark.sql.legacy.parquet.nanosAsLong", "true")
    reader = spark.read.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)


def tidy(stored: DataFrame) -> DataFrame:
    """Stored bar columns under the names used everywhere else, with a real date."""
    names = {c: c.lower().replace(" ", "_") for c in stored.columns if c != "Date"}
    in_ns = isinstance(stored.schema["Date"].dataType, T.LongType)
    date = ns_to_date(F.col("Date")) if in_ns else F.col("Date").cast("date")
    return stored.select(
        date.alias("date"), *[F.col(f"`{c}`").alias(n) for c, n in names.items()]
    )


def ohlcv(
    rows: DataFrame, keys: list[Column], price: Column, order: Column, volume: Column,
    high: Column | None = None, low: Column | None = None, close: Column | None = None,
) -> DataFrame:
    """Bars from ticks. ``order`` must be total within a bar, so that open and close are fixed.

    All aggregates are partial, so a busy instrument is reduced before the exchange.
    """
    return rows.groupBy(*keys).agg(
        F.min_by(price, order).alias("open"),
        F.max(price if high is None else high).alias("high"),
        F.min(price if low is None else low).alias("low"),
        F.max_by(price if close is None else close, order).alias("close"),
        F.sum(volume).cast("double").alias("volume"),
    )


def _in_runs(lineitem: DataFrame, span_days: int) -> DataFrame:
    placed = lineitem.withColumns({"ticker": F.col("l_suppkey"), "date": F.col("l_shipdate").cast("date")})
    return placed.withColumn("_span", F.floor(F.unix_date("date") / span_days))


def shipment_days(lineitem: DataFrame, span_days: int) -> DataFrame:
    """How many bars (``_bars``) each supplier has in a run of days, without making them.

    A run is a few words with a bit for each day, which are partial aggregates and so small before the exchange.
    """
    day = F.pmod(F.unix_date("date"), F.lit(span_days))

    def word(at: int) -> Column:
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), day - at)
        return F.bit_or(F.when((day >= at) & (day < at + 64), bit))

    words = {f"_days_{at}": word(at) for at in range(0, span_days, 64)}
    runs = _in_runs(lineitem, span_days).groupBy("ticker", "_span").agg(*[w.alias(n) for n, w in words.items()])
    days = reduce(add, [F.coalesce(F.bit_count(n), F.lit(0)) for n in words])
    # lines without a date are one bar
    bars = F.when(F.col("_span").isNull(), 1).otherwise(days).cast("bigint").alias("_bars")
    # the runs of a supplier together, as they are added up to number its bars
    return runs.select("ticker", "_span", bars).repartition("ticker")


def shipment_bars(lineitem: DataFrame, span_days: int | None = None) -> DataFrame:
    """Daily bars per supplier, priced from the order lines shipped that day.

    With ``span_days``, lines of one supplier and so many days are brought together first, and the bars
    come with that run of days in ``_span``. They can then be numbered (``index_bars``) where they are.
    """
    price = F.lit(100) * (1 + (F.col("l_extendedprice") - 50000) / F.lit(1e6))
    up, down = F.col("l_tax") / 10, F.col("l_discount") / 10
    keys = [F.col("l_suppkey").alias("ticker"), F.col("l_shipdate").cast("date").alias("date")]
    if span_days is not None:
        lineitem = _in_runs(lineitem, span_days).repartition("ticker", "_span")
        # in the order in which they are numbered, so that the bars of a run are sorted only once
        keys = [F.col("ticker"), F.col("_span"), F.col("date")]
    return ohlcv(
        lineitem,
        keys,
        price=price,
        order=F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"),
        volume=F.col("l_quantity"),
        high=price * (1 + up),
        low=price * (1 - down),
        close=price * (1 + (F.col("l_tax") - F.col("l_discount")) / 10),
    )


def event_ticks(events: DataFrame) -> DataFrame:
    """Ticks: one price per event, per event type."""
    return events.select(
        F.col("event_type").alias("ticker"),
        F.col("ts").cast("timestamp").alias("ts"),
        "event_id",
        F.col("value").alias("price"),
    )


def event_bars(ticks: DataFrame) -> DataFrame:
    return ohlcv(
        ticks,
        [F.col("ticker"), F.col("ts").cast("date").alias("date")],
        price=F.col("price"),
        order=F.struct("ts", "event_id"),
        volume=F.lit(1),
    )


def union_feeds(feeds: Mapping[str, DataFrame]) -> DataFrame:
    """One table out of several feeds, with the feed name; missing columns become NULL."""
    out: DataFrame | None = None
    for name, feed in feeds.items():
        feed = feed.withColumn("feed", F.lit(name))
        out = feed if out is None else out.unionByName(feed, allowMissingColumns=True)
    if out is None:
        raise ValueError("no feed given")
    return out
