"""The feature table of the prediction jobs: one row per entry signal."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators import indicators as ind
from tickloom.operators import trades as tr
from tickloom.plans.steps import Step, compute

# The model inputs, in the order in which they are assembled.
FEATURES = [
    "tmf_w", "tmf_4w_min", "tmf_4w_min_dd", "tmf_26w_min", "tmf_26w_min_dd",
    "tmf_4w_min_dd_qtl_50", "tmf_4w_min_dd_qtl_50_alt",
    "tmf_26w_min_dd_qtl_50", "tmf_26w_min_dd_qtl_50_alt",
    "previous_exit_success", "previous_exit_result_ratio",
    "pdi", "ndi", "adx", "st_up_diff_norm", "st_lo_diff_norm",
    "log_year_cap", "std_vol", "log_vol", "std_cap", "log_cap", "day_of_week",
]


def feature_steps() -> list[Step]:
    """The steps behind all model inputs and the target."""
    return [
        *ind.tmf_floor(), ind.tmf_floor_medians(), ind.tmf_signal(), tr.first_hit_exit(),
        tr.lagged_wins(), ind.adx(), ind.supertrend_bands(multiplier=2), ind.yearly_capital(),
    ]


def signal_features(computed: DataFrame) -> DataFrame:
    """One row per entry signal of bars with the columns of ``feature_steps``."""
    made = {
        "log_year_cap": F.log10(F.col("yearly_cap_xchngd") + 100),
        "day_of_week": F.dayofweek("date") - 1,
    }
    doubles = [made.get(c, F.col(c)).cast("double").alias(c) for c in FEATURES]
    target = F.col("exit_gain_loss")
    return computed.where(F.col("signal") == 1).select("ticker", "date", *doubles, target, target.alias("target"))


def feature_table(indexed: DataFrame) -> DataFrame:
    """All model inputs and the target; every column comes out of one exchange."""
    return signal_features(compute(indexed, *feature_steps()))


def with_split(df: DataFrame, years: Mapping[str, Sequence[int]]) -> DataFrame:
    """Label rows by the list their year is in; rows of other years are dropped."""
    label = F.lit(None).cast("string")
    for name, those in years.items():
        label = F.when(F.year("date").isin(list(those)), name).otherwise(label)
    return df.withColumn("split", label).where(F.col("split").isNotNull())


def complete(df: DataFrame) -> DataFrame:
    """Rows without NULL or NaN."""
    return df.na.drop()
