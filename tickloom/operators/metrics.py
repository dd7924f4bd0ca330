"""Scores of predictions (date, y_true, y_pred), each from one pass over the data.

Rows are first summed up by month, for all thresholds at once, and the months are then
combined; a month or threshold with no prediction adds nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Thresholds of the grid and the power of the Tweedie score.
THRESHOLDS = (1.01, 1.05, 1.10)
TWEEDIE_POWER = 3


def month(date: str = "date") -> Column:
    return F.trunc(date, "month")


def flags(predictions: DataFrame, threshold: float) -> DataFrame:
    return predictions.withColumns(
        {"true_hit": F.col("y_true") > threshold, "pred_hit": F.col("y_pred") > threshold}
    )


def _cells(threshold: float, tag: str = "") -> list[Column]:
    """Confusion counts and the return of predicted rows, at one threshold."""
    hit, told = F.col("y_true") > threshold, F.col("y_pred") > threshold
    return [
        F.count(F.when(hit & told, 1)).alias(f"tp{tag}"),
        F.count(F.when(~hit & told, 1)).alias(f"fp{tag}"),
        F.count(F.when(hit & ~told, 1)).alias(f"fn{tag}"),
        F.count(F.when(~hit & ~told, 1)).alias(f"tn{tag}"),
        F.avg(F.when(told, F.col("y_true"))).alias(f"ret{tag}"),
    ]


def _win(tag: str = "") -> Column:
    """Share of hits among a month's predictions; NULL without any."""
    return F.try_divide(F.col(f"tp{tag}"), F.col(f"tp{tag}") + F.col(f"fp{tag}"))


def _scores(tag: str = "") -> dict[str, Column]:
    """Scores over the months, by name."""
    tp, fp = F.sum(f"tp{tag}"), F.sum(f"fp{tag}")
    return {
        "precision_at": F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0)),
        "true_positive_at": tp.cast("double"),
        "monthly_win_ratio_avg": F.coalesce(F.avg(_win(tag)), F.lit(0.0)),
        "monthly_win_ratio_std": F.coalesce(F.stddev_pop(_win(tag)), F.lit(0.0)),
        "mthly_rtrn_pct_avg": F.coalesce(F.avg(f"ret{tag}"), F.lit(1.0)),
        "mthly_rtrn_pct_std": F.coalesce(F.stddev_pop(f"ret{tag}"), F.lit(0.0)),
    }


def by_month(predictions: DataFrame, threshold: float) -> DataFrame:
    return predictions.groupBy(month().alias("month")).agg(*_cells(threshold))


def _score(predictions: DataFrame, threshold: float, name: str) -> DataFrame:
    return by_month(predictions, threshold).agg(_scores()[name].alias(name))


def precision_at(predictions: DataFrame, threshold: float) -> DataFrame:
    return _score(predictions, threshold, "precision_at")


def true_positive_at(predictions: DataFrame, threshold: float) -> DataFrame:
    return _score(predictions, threshold, "true_positive_at")


def confusion_at(predictions: DataFrame, threshold: float) -> DataFrame:
    return by_month(predictions, threshold).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in ("tp", "fp", "fn", "tn")]
    )


def monthly_return_avg(predictions: DataFrame, threshold: float) -> DataFrame:
    return _score(predictions, threshold, "mthly_rtrn_pct_avg")


def monthly_return_std(predictions: DataFrame, threshold: float) -> DataFrame:
    return _score(predictions, threshold, "mthly_rtrn_pct_std")


def monthly_win_avg(predictions: DataFrame, threshold: float) -> DataFrame:
    return _score(predictions, threshold, "monthly_win_ratio_avg")


def monthly_win_std(predictions: DataFrame, threshold: float) -> DataFrame:
    return _score(predictions, threshold, "monthly_win_ratio_std")


# ---- errors and deviances ----------------------------------------------------------------


def tweedie_unit(power: float) -> Column:
    """Unit deviance of the Tweedie family (0 normal, 1 Poisson, 2 gamma)."""
    y, m = F.col("y_true"), F.col("y_pred")
    if power == 0:
        return (y - m) * (y - m)
    if power == 1:
        return 2 * (F.when(y == 0, 0.0).otherwise(y * F.ln(y / m)) - y + m)
    if power == 2:
        return 2 * (F.ln(m / y) + y / m - 1)
    p = float(power)
    return 2 * (
        F.pow(y, F.lit(2 - p)) / ((1 - p) * (2 - p))
        - y * F.pow(m, F.lit(1 - p)) / (1 - p)
        + F.pow(m, F.lit(2 - p)) / (2 - p)
    )


def _error_units() -> dict[str, Column]:
    return {
        "mean_absolute_error": F.abs(F.col("y_true") - F.col("y_pred")),
        "mean_squared_error": tweedie_unit(0),
        "mean_poisson_deviance": tweedie_unit(1),
        "mean_gamma_deviance": tweedie_unit(2),
        f"mean_tweedie_deviance__power_{TWEEDIE_POWER}": tweedie_unit(TWEEDIE_POWER),
    }


def errors(predictions: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    units = _error_units()
    return predictions.agg(*[F.avg(units[n]).alias(n) for n in names or units])


def mae_mse(predictions: DataFrame) -> DataFrame:
    return errors(predictions, ["mean_absolute_error", "mean_squared_error"])


def deviances(predictions: DataFrame) -> DataFrame:
    return errors(predictions, [n for n in _error_units() if "deviance" in n])


def metric_grid(
    predictions: DataFrame, thresholds: Sequence[float] = THRESHOLDS, keys: Sequence[str] = ()
) -> DataFrame:
    """All scores at all thresholds and all errors as (metric, value), optionally per key.

    One exchange by month; thresholds are columns of the same pass, not copies of the rows.
    """
    keys = list(keys)
    cells = [c for i, t in enumerate(thresholds) for c in _cells(t, f"_{i}")]
    units = _error_units()
    sums = [F.sum(u).alias(f"_e{i}") for i, u in enumerate(units.values())]
    months = predictions.groupBy(*keys, month().alias("month")).agg(
        *cells, *sums, F.count(F.lit(1)).alias("_rows")
    )
    named: dict[str, Column] = {}
    for i, threshold in enumerate(thresholds):
        for name, score in _scores(f"_{i}").items():
            named[f"{name}__threshold_{threshold}"] = score
    for i, name in enumerate(units):
        named[name] = F.try_divide(F.sum(f"_e{i}"), F.sum("_rows"))
    row = F.array(
        *[F.struct(F.lit(n).alias("metric"), v.cast("double").alias("value")) for n, v in named.items()]
    )
    wide = months.groupBy(*keys).agg(row.alias("all"))
    return wide.select(*keys, F.explode("all").alias("m")).select(*keys, "m.metric", "m.value")


# ---- return tables -------------------------------------------------------------------------


def monthly_return(predictions: DataFrame, threshold: float) -> DataFrame:
    """Return of the predicted rows by month."""
    told = predictions.where(F.col("y_pred") > threshold)
    return told.groupBy(month().alias("month")).agg(
        F.avg("y_true").alias("monthly_return_average"),
        F.stddev_pop("y_true").alias("monthly_return_std"),
        F.min("y_true").alias("monthly_min_trade"),
        F.max("y_true").alias("monthly_max_trade"),
    )


def yearly_return(predictions: DataFrame, threshold: float) -> DataFrame:
    """Product of the monthly means, and its spread if the months are independent."""
    told = predictions.where(F.col("y_pred") > threshold)
    months = told.groupBy(month().alias("month")).agg(
        F.avg("y_true").alias("m"), F.var_pop("y_true").alias("v")
    )
    mean = F.product("m")
    square = F.product(F.col("m") * F.col("m") + F.col("v"))
    return months.groupBy(F.year("month").alias("year")).agg(
        mean.alias("yearly_exponential_return"),
        F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))).alias("yearly_std"),
    )
