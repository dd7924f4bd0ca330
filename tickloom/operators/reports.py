"""Reports on trades and bars: by instrument, year, month and over everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tickloom.functions.arrays import all_above
from tickloom.functions.numeric import ieee_div
from tickloom.operators.series import drawdown
from tickloom.plans.layout import POSITION, index_bars
from tickloom.plans.scan import dense_rank_by

# Yearly review rules.
GOOD_RETURN, GOOD_RATIO = 1.05, 2
HISTORY_YEARS, ENOUGH_YEARS, LAST_REFERENCE_YEAR = 5, 10, 2020
TRADING_DAYS = 252

# ---- trades by instrument and year -----------------------------------------------------


def trade_year(trades: DataFrame, ratio: str = "exit_gain_loss") -> DataFrame:
    """Mean return, number of trades, won and lost, by instrument and year."""
    r = F.col(ratio)
    return trades.groupBy("ticker", F.year("date").alias("year")).agg(
        F.avg(r).alias("avg_return"),
        F.count(r).alias("trade_count"),
        F.count(F.when(r > 1, 1)).alias("trades_won"),
        F.count(F.when(r < 1, 1)).alias("trades_lost"),
    )


def year_profile(years: DataFrame) -> DataFrame:
    """All instruments together, by year."""
    weighted = F.sum(F.col("avg_return") * F.col("trade_count"))
    return years.groupBy("year").agg(
        F.sum("trade_count").alias("opportunities"),
        F.sum("trades_won").alias("success"),
        F.sum("trades_lost").alias("fail"),
        ieee_div(
            F.sum("trades_won").cast("double"), F.sum("trades_lost").cast("double")
        ).alias("success_fail_ratio"),
        ieee_div(weighted, F.sum("trade_count").cast("double")).alias("avg_return_rate"),
    )


def with_win_loss(years: DataFrame) -> DataFrame:
    won, lost = F.col("trades_won").cast("double"), F.col("trades_lost").cast("double")
    return years.withColumn("win_loss_ratio", ieee_div(won, lost))


def ranked_by_year(years: DataFrame) -> DataFrame:
    """Dense rank of the win/loss ratio within each year, best first."""
    return dense_rank_by(with_win_loss(years), ["year"], "win_loss_ratio", "drnk")


def top_by_year(years: DataFrame, below: int = 10) -> DataFrame:
    """Instrument-years whose rank is under ``below``.

    The best distinct ratios of each year are found first (Spark limits them before the
    exchange), so that any number of ties is joined back without meeting in one task.
    """
    rated = with_win_loss(years)
    w = Window.partitionBy("year").orderBy(F.desc("win_loss_ratio"))
    best = (
        rated.select("year", "win_loss_ratio")
        .distinct()
        .withColumn("drnk", F.dense_rank().over(w))
        .where(F.col("drnk") < below)
    )
    return rated.join(best, ["year", "win_loss_ratio"])


def by_instrument() -> WindowSpec:
    """Years of one instrument; at most one row per calendar year."""
    return Window.partitionBy("ticker").orderBy("year")


def with_previous_year(years: DataFrame) -> DataFrame:
    """The instrument's previous row: its trade count and ratio."""
    w = by_instrument()
    return with_win_loss(years).withColumns(
        {
            "prev_trade_count": F.lag("trade_count").over(w),
            "prev_win_loss_ratio": F.lag("win_loss_ratio").over(w),
        }
    )


def with_history(years: DataFrame, length: int = HISTORY_YEARS) -> DataFrame:
    """The ratios of up to ``length`` rows before, oldest first."""
    frame = by_instrument().rowsBetween(-length, -1)
    return with_win_loss(years).withColumn(
        "history", F.collect_list("win_loss_ratio").over(frame)
    )


def consistent_history(years: DataFrame, length: int = HISTORY_YEARS) -> DataFrame:
    """Instrument-years before which ``length`` years in a row had more wins than losses."""
    rows = with_history(years, length)
    return rows.where(all_above(F.col("history"), 1) & (F.size("history") == length))


def ratio_bin(ratio: Column) -> Column:
    """The labels of the bins, and where these end."""
    return F.when(ratio < 1, "less than 1").when(ratio < 2, "less than 2").otherwise("more than 2")


def bin_counts(years: DataFrame) -> DataFrame:
    return years.groupBy(ratio_bin(F.col("win_loss_ratio")).alias("category")).agg(
        F.count(F.lit(1)).alias("tally")
    )


def good_years(
    years: DataFrame, last_year: int = LAST_REFERENCE_YEAR, least_return: float = GOOD_RETURN, above_ratio: float = GOOD_RATIO
) -> DataFrame:
    """Instrument-years up to ``last_year`` with a good mean return and a good win/loss ratio."""
    return with_win_loss(years).where(
        (F.col("avg_return") >= least_return)
        & (F.col("win_loss_ratio") > above_ratio)
        & (F.col("year") <= last_year)
    )


def occurrences(good: DataFrame) -> DataFrame:
    return good.groupBy("ticker").agg(F.count(F.lit(1)).alias("occurrence"))


def occurrence_hist(counts: DataFrame) -> DataFrame:
    return counts.groupBy("occurrence").agg(F.count(F.lit(1)).alias("tickers"))


def consistent_tickers(counts: DataFrame, at_least: int = ENOUGH_YEARS) -> DataFrame:
    return counts.where(F.col("occurrence") >= at_least)


def join_qualified(years: DataFrame, qualified: DataFrame, after_year: int) -> DataFrame:
    """Later years of the qualified instruments.

    No broadcast is forced: adaptive execution broadcasts the list if it measures small,
    and splits hot instruments otherwise.
    """
    later = with_win_loss(years).where(F.col("year") > after_year)
    return later.join(qualified, "ticker")


def with_year_before(rows: DataFrame) -> DataFrame:
    """Left join of each instrument-year with the year before it."""
    before = rows.select(
        "ticker",
        (F.col("year") + 1).alias("year"),
        F.col("trade_count").alias("prev_year_trade_count"),
        F.col("win_loss_ratio").alias("prev_year_win_loss_ratio"),
    )
    return rows.join(before, ["ticker", "year"], "left")


def oos_verification(
    years: DataFrame, last_year: int = LAST_REFERENCE_YEAR, at_least: int = ENOUGH_YEARS,
    least_return: float = GOOD_RETURN, above_ratio: float = GOOD_RATIO,
) -> DataFrame:
    """Instruments picked on the reference years, checked on the years after them."""
    picked = consistent_tickers(occurrences(good_years(years, last_year, least_return, above_ratio)), at_least)
    base = join_qualified(years, picked, last_year)
    return with_year_before(base).where(F.col("prev_year_win_loss_ratio") > 1)


def win_loss_summary(trades: DataFrame, ratio: str = "exit_gain_loss") -> DataFrame:
    r = F.col(ratio)
    return trades.groupBy("ticker").agg(
        F.count(F.when(r > 1, 1)).alias("win"),
        F.avg(F.when(r > 1, r)).alias("avg_win_ratio"),
        F.count(F.when(r < 1, 1)).alias("loss"),
        F.avg(F.when(r < 1, r)).alias("avg_loss_ratio"),
    )


def yearly_consistency(years: DataFrame) -> DataFrame:
    """Share of an instrument's years with a mean return above 1."""
    good = F.count(F.when(F.col("avg_return") > 1, 1))
    return years.where(F.col("avg_return").isNotNull()).groupBy("ticker").agg(
        F.count(F.lit(1)).alias("years"),
        good.alias("good_years"),
        (good / F.count(F.lit(1))).alias("consistency"),
    )


def rank_by_product(trades: DataFrame, ratio: str = "exit_gain_loss") -> DataFrame:
    """Instruments by the product of their trade ratios, best first."""
    products = trades.where(F.col(ratio).isNotNull()).groupBy("ticker").agg(
        F.product(ratio).alias("product"), F.count(F.lit(1)).alias("trade_count")
    )
    return dense_rank_by(products, [], "product", "drnk")


# ---- bars ------------------------------------------------------------------------------


def tickers_per_year(bars: DataFrame) -> DataFrame:
    return bars.groupBy(F.year("date").alias("year")).agg(
        F.count_distinct("ticker").alias("tickers")
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("count"))


def column_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("rows"), *[F.max(c).alias(f"max_{c}") for c in columns]
    )


def indicator_range(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy("ticker").agg(
        F.min(column).alias("min_value"),
        F.max(column).alias("max_value"),
        F.avg(column).alias("mean_value"),
        F.stddev_samp(column).alias("std_value"),
    )


def max_drawdown(indexed: DataFrame) -> DataFrame:
    return drawdown(indexed).groupBy("ticker").agg(F.min("drawdown").alias("max_drawdown"))


def sharpe(returns: DataFrame) -> DataFrame:
    """Mean over spread of the bar returns (column ``ret``), on a yearly scale."""
    return returns.groupBy("ticker").agg(
        (
            F.try_divide(F.avg("ret"), F.stddev_samp("ret")) * F.sqrt(F.lit(float(TRADING_DAYS)))
        ).alias("sharpe")
    )


def annualised_return(bars: DataFrame) -> DataFrame:
    days = F.datediff(F.max("date"), F.min("date"))
    growth = ieee_div(F.max_by("close", "date"), F.min_by("close", "date"))
    return bars.groupBy("ticker").agg(
        F.when(days > 0, F.pow(growth, F.lit(365.0) / F.nullif(days, F.lit(0))) - 1).alias(
            "annualised_return"
        )
    )


def hold_return(bars: DataFrame) -> DataFrame:
    """Buy at the first open of the year, hold to its last close."""
    return bars.groupBy("ticker", F.year("date").alias("year")).agg(
        ieee_div(F.max_by("close", "date"), F.min_by("open", "date")).alias("hold_return")
    )


def best_per_month(bars: DataFrame) -> DataFrame:
    """The instrument with the highest return within each month; the lower key on a tie."""
    monthly = bars.groupBy(F.trunc("date", "month").alias("month"), "ticker").agg(
        ieee_div(F.max_by("close", "date"), F.min_by("open", "date")).alias("ret")
    )
    rated = monthly.where(F.col("ret").isNotNull() & ~F.isnan("ret"))
    return rated.groupBy("month").agg(
        F.min_by(F.struct("ticker", "ret"), F.struct(-F.col("ret"), F.col("ticker"))).alias("b")
    ).select("month", F.col("b.ticker").alias("ticker"), F.col("b.ret").alias("best_return"))


def index_series(bars: DataFrame) -> DataFrame:
    """Equal-weight index: mean close of all instruments by date."""
    return bars.groupBy("date").agg(F.avg("close").alias("index_close"))


def with_index(bars: DataFrame, index: DataFrame) -> DataFrame:
    return bars.join(index, "date", "left").withColumn(
        "rel_close", ieee_div(F.col("close"), F.col("index_close"))
    )


def unpivot(df: DataFrame, ids: list[str], values: list[str]) -> DataFrame:
    return df.unpivot(ids, values, "variable", "value")


def numbered_trades(trades: DataFrame) -> DataFrame:
    """Trades with an outcome, numbered 1, 2, ... within each instrument."""
    done = trades.where(F.col("exit_gain_loss").isNotNull()).drop(POSITION)
    return index_bars(done).withColumnRenamed(POSITION, "trade_no")
