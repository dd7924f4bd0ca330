"""Counts and quantiles from sketches that are stored once and merged for any report.

A table holds one row per instrument and month: the number of bars, a sketch of the instruments and one of a value. Months and
instruments of a report are merged from these rows, without the bars. Sketches have a fixed size, so the table
grows with instruments and months only.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sizes of the sketches. A count of instruments has a standard error of 1.04 / sqrt(2 ** COUNT_SIZE).
COUNT_SIZE, RANK_SIZE = 12, 200
COUNT_ERROR = 3 * 1.04 / 2 ** (COUNT_SIZE / 2)
#: How far the rank of a quantile can be from the one asked for, with a chance of 99 %: 2.446 / RANK_SIZE ** 0.9433.
RANK_ERROR = 2.446 / RANK_SIZE**0.9433


def monthly_sketches(bars: DataFrame, value: str = "close") -> DataFrame:
    """(ticker, month, n_bars, n_values, instruments, ranks) of bars; null and NaN values are in no sketch of ranks."""
    x = F.col(value).cast("double")
    known = F.when(~F.isnan(x), x)
    return bars.groupBy("ticker", F.trunc("date", "month").alias("month")).agg(
        F.count(F.lit(1)).alias("n_bars"),
        F.count(known).alias("n_values"),
        F.hll_sketch_agg(F.col("ticker"), COUNT_SIZE).alias("instruments"),
        F.kll_sketch_agg_double(known, RANK_SIZE).alias("ranks"),
    )


def merged(sketches: DataFrame, by: Mapping[str, Column], quantiles: Mapping[str, float]) -> DataFrame:
    """One row per group of ``by`` (over everything without): n_bars, instruments (estimate) and the quantiles by name.

    Groups without a value have null quantiles.
    """
    groups = sketches.groupBy(*(column.alias(name) for name, column in by.items()))
    rows = groups.agg(
        F.sum("n_bars").alias("n_bars"),
        F.hll_sketch_estimate(F.hll_union_agg("instruments")).alias("instruments"),
        F.sum("n_values").alias("n_values"),
        F.kll_merge_agg_double("ranks").alias("ranks"),
    )
    some = F.col("n_values") > 0
    found = [
        F.when(some, F.kll_sketch_get_quantile_double("ranks", F.lit(rank))).alias(name) for name, rank in quantiles.items()
    ]
    return rows.select(*by, "n_bars", "instruments", *found)
