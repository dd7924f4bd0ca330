"""Scores of predictions and model jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.catalog import views as v
from tickloom.catalog.registry import query
from tickloom.catalog.sql import r, rs, sql, view
from tickloom.catalog.tables import COMPLETE
from tickloom.operators import features as feat
from tickloom.operators import metrics as met
from tickloom.operators import models
from tickloom.sources import store

THRESHOLD = 1.01
MONTH = "CAST(date_trunc('month', date) AS DATE)"


def cells_sql(threshold: float) -> str:
    return f"""
        SELECT {MONTH} AS month,
               count(*) FILTER (WHERE y_true > {threshold} AND y_pred > {threshold}) AS tp,
               count(*) FILTER (WHERE NOT y_true > {threshold} AND y_pred > {threshold}) AS fp,
               count(*) FILTER (WHERE y_true > {threshold} AND NOT y_pred > {threshold}) AS fn,
               count(*) FILTER (WHERE NOT y_true > {threshold} AND NOT y_pred > {threshold}) AS tn,
               avg(y_true) FILTER (WHERE y_pred > {threshold}) AS ret
        FROM preds GROUP BY 1
    """


WIN = "CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) END"
SCORES = {
    "precision_at": "coalesce(CASE WHEN sum(tp + fp) > 0 THEN CAST(sum(tp) AS DOUBLE) / CAST(sum(tp + fp) AS DOUBLE) END, 0)",
    "true_positive_at": "CAST(sum(tp) AS DOUBLE)",
    "monthly_win_ratio_avg": f"coalesce(avg({WIN}), 0)",
    "monthly_win_ratio_std": f"coalesce(stddev_pop({WIN}), 0)",
    "mthly_rtrn_pct_avg": "coalesce(avg(ret), 1)",
    "mthly_rtrn_pct_std": "coalesce(stddev_pop(ret), 0)",
}
DEVIANCES = {
    "mean_poisson_deviance": "2 * avg(CASE WHEN y_true = 0 THEN 0 ELSE y_true * ln(y_true / y_pred) END - y_true + y_pred)",
    "mean_gamma_deviance": "2 * avg(ln(y_pred / y_true) + y_true / y_pred - 1)",
    "mean_tweedie_deviance__power_3": "avg(pow(y_true - y_pred, 2) / (y_true * pow(y_pred, 2)))",
}
ERRORS = {
    "mean_absolute_error": "avg(abs(y_true - y_pred))",
    "mean_squared_error": "avg(pow(y_true - y_pred, 2))",
}


def score(key: str, name: str, function) -> None:
    @query(key, sql(f"SELECT {r(SCORES[name])} AS {name} FROM ({cells_sql(THRESHOLD)})", "preds"))
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return function(v.predictions(spark, folder), THRESHOLD).select(v.r(name))


score("precision_at", "precision_at", met.precision_at)
score("monthly_return_avg", "mthly_rtrn_pct_avg", met.monthly_return_avg)
score("monthly_return_std", "mthly_rtrn_pct_std", met.monthly_return_std)
score("monthly_win_avg", "monthly_win_ratio_avg", met.monthly_win_avg)
score("monthly_win_std", "monthly_win_ratio_std", met.monthly_win_std)


@query(
    "confusion_at",
    sql(
        "SELECT "
        + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ("tp", "fp", "fn", "tn"))
        + f" FROM ({cells_sql(THRESHOLD)})",
        "preds",
    ),
)
def confusion_at(spark: SparkSession, folder: str) -> DataFrame:
    return met.confusion_at(v.predictions(spark, folder), THRESHOLD)


def errors_sql(units: dict[str, str]) -> str:
    return "SELECT " + ", ".join(f"{r(x)} AS {n}" for n, x in units.items()) + " FROM preds"


@query("mae_mse", sql(errors_sql(ERRORS), "preds"))
def mae_mse(spark: SparkSession, folder: str) -> DataFrame:
    return met.mae_mse(v.predictions(spark, folder)).select(*[v.r(n) for n in ERRORS])


@query("deviances", sql(errors_sql(DEVIANCES), "preds"))
def deviances(spark: SparkSession, folder: str) -> DataFrame:
    return met.deviances(v.predictions(spark, folder)).select(*[v.r(n) for n in DEVIANCES])


GRID = " UNION ALL ".join(
    [
        f"SELECT '{n}__threshold_{t}' AS metric, {r(x)} AS value FROM ({cells_sql(t)})"
        for t in met.THRESHOLDS
        for n, x in SCORES.items()
    ]
    + [f"SELECT '{n}' AS metric, {r(x)} AS value FROM preds" for n, x in {**ERRORS, **DEVIANCES}.items()]
)


@query("metric_grid", sql(GRID, "preds"))
def metric_grid(spark: SparkSession, folder: str) -> DataFrame:
    return met.metric_grid(v.predictions(spark, folder)).select("metric", v.r("value"))


RETURNS = ("monthly_return_average", "monthly_return_std", "monthly_min_trade", "monthly_max_trade")


@query(
    "monthly_return",
    sql(
        f"""
        SELECT {MONTH} AS month, {r('avg(y_true)')} AS monthly_return_average,
               {r('stddev_pop(y_true)')} AS monthly_return_std, {r('min(y_true)')} AS monthly_min_trade,
               {r('max(y_true)')} AS monthly_max_trade
        FROM preds WHERE y_pred > {THRESHOLD} GROUP BY 1
        """,
        "preds",
    ),
)
def monthly_return(spark: SparkSession, folder: str) -> DataFrame:
    out = met.monthly_return(v.predictions(spark, folder), THRESHOLD)
    return out.select("month", *[v.r(c) for c in RETURNS]).orderBy("month")


@query(
    "yearly_return",
    sql(
        f"""
        SELECT CAST(year(month) AS INTEGER) AS year, {r('product(m)')} AS yearly_exponential_return,
               {r('sqrt(greatest(product(m * m + s) - product(m) * product(m), 0))')} AS yearly_std
        FROM (SELECT {MONTH} AS month, avg(y_true) AS m, var_pop(y_true) AS s FROM preds
              WHERE y_pred > {THRESHOLD} GROUP BY 1) GROUP BY 1
        """,
        "preds",
    ),
)
def yearly_return(spark: SparkSession, folder: str) -> DataFrame:
    out = met.yearly_return(v.predictions(spark, folder), THRESHOLD)
    return out.select("year", v.r("yearly_exponential_return"), v.r("yearly_std")).orderBy("year")


# ---- features and models ---------------------------------------------------------------------------


@query(
    "feature_table",
    sql(f"SELECT ticker, date, {rs(*feat.FEATURES, 'exit_gain_loss', 'target')} FROM features", "features"),
)
def feature_table(spark: SparkSession, folder: str) -> DataFrame:
    return shown_features(v.features(spark, folder))


def shown_features(features: DataFrame) -> DataFrame:
    return v.by_bar(features, rounded=(*feat.FEATURES, "exit_gain_loss", "target"))


def split_rows(spark: SparkSession, folder: str) -> DataFrame:
    return feat.with_split(feat.complete(v.features(spark, folder)), v.SPLIT)


view("complete", "features", f"SELECT * FROM features WHERE {COMPLETE}")
for _split in ("validate", "test"):
    _years = ", ".join(map(str, v.SPLIT[_split]))
    _train = ", ".join(map(str, v.SPLIT["train"]))
    view(
        f"preds_{_split}", "complete",
        f"""
        SELECT date, target AS y_true, (SELECT avg(target) FROM complete WHERE year(date) IN ({_train})) AS y_pred
        FROM complete WHERE year(date) IN ({_years})
        """,
    )


@query(
    "dt_depth0",
    sql(
        " UNION ALL ".join(
            f"SELECT '{s}' AS split, metric, value FROM ({GRID.replace('preds', f'preds_{s}')})" for s in ("validate", "test")
        ),
        "preds_validate", "preds_test",
    ),
)
def dt_depth0(spark: SparkSession, folder: str) -> DataFrame:
    """A tree without a split predicts the mean of the training target: all scores can be compared."""
    rows = split_rows(spark, folder)
    model = models.fit(rows.where("split = 'train'"), "decision_tree", {"max_depth": 0})
    return models.scores(model, rows.where("split <> 'train'")).select("split", "metric", v.r("value"))


def model_scores(key: str, kind: str, **params: int) -> None:
    @query(key)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        rows = split_rows(spark, folder)
        model = models.fit(rows.where("split = 'train'"), kind, params)
        return models.scores(model, rows.where("split <> 'train'"))


model_scores("dt_scores", "decision_tree", max_depth=5)
model_scores("rf_scores", "random_forest", max_depth=5, trees=10)
model_scores("gbt_scores", "gradient_boosting", max_depth=3, iterations=5)


@query("param_search")
def param_search(spark: SparkSession, folder: str) -> DataFrame:
    ledger, best = models.param_search(split_rows(spark, folder), models.random_trials())
    return ledger.withColumn("is_best", F.col("trial") == best)


@query("perm_importance")
def perm_importance(spark: SparkSession, folder: str) -> DataFrame:
    rows = split_rows(spark, folder)
    model = models.fit(rows.where("split = 'train'"), "decision_tree", {"max_depth": 5})
    held_out = rows.where("split = 'validate'")
    return models.permutation_importance(model, held_out)


@query("run_ledger")
def run_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Two searches append their runs to one table, which is then read back."""
    path = store.fresh(spark, "run_ledger")
    rows = split_rows(spark, folder)
    for trial in (("decision_tree", {"max_depth": 2}), ("decision_tree", {"max_depth": 4})):
        ledger, _ = models.param_search(rows, [trial])
        models.append_ledger(ledger, path)
    return models.read_ledger(spark, path)
