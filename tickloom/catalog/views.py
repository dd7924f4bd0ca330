"""The tables the queries start from: bars, trades, predictions, features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators import features as feat
from tickloom.operators import indicators as ind
from tickloom.operators import reports
from tickloom.operators import trades as tr
from tickloom.plans.layout import POSITION, index_bars
from tickloom.plans.steps import Step, compute
from tickloom.sources import bars as src
from tickloom.sources.store import layer, table

# The years of the given tables, in place of the default ones.
SPLIT = {"train": [1995, 1996, 1997, 1998], "validate": [1999, 2000], "test": [2001]}
LAST_YEAR, ENOUGH, HISTORY = 1998, 2, 2
# Years that count for the choice of instruments: enough of them that some instruments pass and some do not.
FAIR = {"least_return": 1.0, "above_ratio": 1.0}
SINCE = "1998-01-01"
# Days of one supplier whose lines meet in one task: short, so that a busy one is spread over many.
RUN_DAYS = 128


def plain_bars(spark: SparkSession, folder: str) -> DataFrame:
    """Daily bars, written before they are numbered, since numbering reads them twice."""
    return layer(spark, folder, "plain_bars", lambda: src.shipment_bars(table(spark, folder, "lineitem")))


def bars(spark: SparkSession, folder: str) -> DataFrame:
    """Numbered daily bars, written once per application and read by every query.

    One exchange of the lines serves the bars and their numbers; the runs of days are counted before theirs.
    """

    def build() -> DataFrame:
        lines = table(spark, folder, "lineitem")
        made, counts = src.shipment_bars(lines, RUN_DAYS), src.shipment_days(lines, RUN_DAYS)
        return index_bars(made, span=F.col("_span"), counts=counts)

    return layer(spark, folder, "bars", build)


def trades(spark: SparkSession, folder: str) -> DataFrame:
    """Signal bars with their outcome."""

    def build() -> DataFrame:
        out = compute(bars(spark, folder), ind.tmf_signal(), tr.first_hit_exit())
        return out.where(F.col("signal") == 1).select(
            "ticker", "date", POSITION, "tmf_w", "entry_price", "entry_date", "exit_point",
            "exit_price", "exit_date", "exit_reason", "exit_gain_loss",
            (F.col(POSITION) + 1 + F.col("exit_point")).alias("exit_bar"),
        )

    return layer(spark, folder, "trades", build)


def trade_year(spark: SparkSession, folder: str) -> DataFrame:
    return reports.trade_year(trades(spark, folder))


def features(spark: SparkSession, folder: str) -> DataFrame:
    return layer(spark, folder, "features", lambda: feat.feature_table(bars(spark, folder)))


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        F.col("l_shipdate").cast("date").alias("date"),
        (0.90 + 2 * F.col("l_discount")).alias("y_true"),
        (0.92 + 2 * F.col("l_tax")).alias("y_pred"),
    )


def ticks(spark: SparkSession, folder: str) -> DataFrame:
    return src.event_ticks(table(spark, folder, "events"))


def on_bars(spark: SparkSession, folder: str, *steps: Step) -> DataFrame:
    return compute(bars(spark, folder), *steps)


def single(value: Column) -> Column:
    """A computed value in single precision, as the comparison SQL gives it."""
    return F.round(value, 11).cast("float").cast("double")


def r(name: str) -> Column:
    return single(F.col(name)).alias(name)


def fixed(value: Column) -> Column:
    """A difference of close values, to six decimals."""
    return F.round(value, 6)


def by_bar(
    df: DataFrame, *exact: str, rounded: tuple[str, ...] = (), gaps: tuple[str, ...] = ()
) -> DataFrame:
    """(ticker, date) and the wanted columns; sums in single precision, ``gaps`` to six decimals."""
    small = [fixed(F.col(c)).alias(c) for c in gaps]
    return df.select("ticker", "date", *exact, *[r(c) for c in rounded], *small)
