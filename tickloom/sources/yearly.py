"""Yearly trade tables as they are stored: one row per instrument and year, under descriptive column names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from tickloom.sources.store import write_parquet

# The stored names, and the names that the reports use.
STORED = {
    "Ticker": "ticker",
    "year(Date)": "year",
    "average trade return": "avg_return",
    "total trade count": "trade_count",
    "trade won": "trades_won",
    "trade loss": "trades_lost",
}


def write_trade_years(years: DataFrame, path: str) -> None:
    """Write the result of ``reports.trade_year`` under the stored names."""
    write_parquet(years.select(*(F.col(own).alias(name) for name, own in STORED.items())), path)


def stored_frame(spark: SparkSession, path: str, ticker: str = "bigint") -> DataFrame:
    """The stored tables of a folder under their own names, with a declared schema.

    ``ticker`` is the type of the instrument column. Parts may have their columns in any order, and others besides; a part
    without one of the columns gives null there.
    """
    counts = [StructField(name, LongType()) for name in list(STORED)[3:]]
    key = StructType.fromDDL(f"Ticker {ticker}, `year(Date)` int")
    schema = StructType([*key.fields, StructField("average trade return", DoubleType()), *counts])
    return spark.read.schema(schema).parquet(path)


def read_trade_years(spark: SparkSession, path: str, ticker: str = "bigint") -> DataFrame:
    """The stored tables under the names that the reports use."""
    frame = stored_frame(spark, path, ticker)
    return frame.select(*(F.col(f"`{name}`").alias(own) for name, own in STORED.items()))
