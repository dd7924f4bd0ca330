"""Trade outcomes and reports on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.catalog import views as v
from tickloom.catalog.registry import ORACLES, query
from tickloom.catalog.sql import past, r, rs, sql
from tickloom.catalog.tables import BIN_SQL
from tickloom.functions.numeric import ieee_div
from tickloom.operators import indicators as ind
from tickloom.operators import reports, series, sketches
from tickloom.operators import trades as tr
from tickloom.plans.steps import Step
from tickloom.sources import store, yearly

# ---- exits -----------------------------------------------------------------------------------


@query(
    "exit_first_hit",
    sql(
        "SELECT ticker, date, entry_price, exit_point, exit_price, exit_gain_loss, entry_date, exit_date FROM outcomes",
        "outcomes",
    ),
)
def exit_first_hit(spark: SparkSession, folder: str) -> DataFrame:
    out = v.on_bars(spark, folder, tr.first_hit_exit())
    return v.by_bar(
        out, "entry_price", "exit_point", "exit_price", "exit_gain_loss", "entry_date", "exit_date"
    )


@query("exit_reason", sql("SELECT ticker, date, exit_reason FROM outcomes", "outcomes"))
def exit_reason(spark: SparkSession, folder: str) -> DataFrame:
    return v.by_bar(v.on_bars(spark, folder, tr.first_hit_exit()), "exit_reason")


def both_rules() -> tuple[Step, Step]:
    return tr.exit_from_signal_bar(tr.WIDE), tr.exit_from_signal_bar(tr.NARROW, "2")


@query("exit_index_spark_form", sql("SELECT ticker, date, exit_index, exit_index2 FROM exit_both", "exit_both"))
def exit_index_spark_form(spark: SparkSession, folder: str) -> DataFrame:
    return v.by_bar(v.on_bars(spark, folder, *both_rules()), "exit_index", "exit_index2")


@query("exit_slip_price", sql("SELECT ticker, date, exit_slip_price, exit_slip_price2 FROM exit_both", "exit_both"))
def exit_slip_price(spark: SparkSession, folder: str) -> DataFrame:
    return v.by_bar(v.on_bars(spark, folder, *both_rules()), "exit_slip_price", "exit_slip_price2")


@query("commission_cost", sql(f"SELECT ticker, date, {r('exit_gain_loss - 0.002')} AS net_ratio FROM trades", "trades"))
def commission_cost(spark: SparkSession, folder: str) -> DataFrame:
    trades = v.trades(spark, folder)
    return v.by_bar(trades.withColumn("net_ratio", tr.net_ratio(F.col("exit_gain_loss"))), rounded=("net_ratio",))


@query(
    "gain_loss_ratio",
    sql(
        f"""
        SELECT ticker, date, {rs('gain_loss_ratio', 'gain_loss_ratio2')},
               {r('CASE WHEN close > open THEN 1 ELSE 0 END * (exit_slip_price / buy_price - 0.002)')} AS signal_ratio
        FROM exit_both
        """,
        "exit_both",
    ),
)
def gain_loss_ratio(spark: SparkSession, folder: str) -> DataFrame:
    """Slip price against the entry price, and against the next open for signalled bars."""
    out = v.on_bars(spark, folder, *both_rules())
    buy = F.when(F.col("close") > F.col("open"), 1).otherwise(0)
    out = out.withColumn(
        "signal_ratio", buy * tr.net_ratio(ieee_div(F.col("exit_slip_price"), F.col("buy_price")))
    )
    return v.by_bar(out, rounded=("gain_loss_ratio", "gain_loss_ratio2", "signal_ratio"))


@query("past_success_ratio", sql(f"SELECT ticker, date, {rs('previous_exit_result_ratio')} FROM past", "past"))
def past_success_ratio(spark: SparkSession, folder: str) -> DataFrame:
    return v.by_bar(v.on_bars(spark, folder, tr.lagged_wins()), rounded=("previous_exit_result_ratio",))


INCL = [f"previous_exit_{k}_incl{n}" for n in ("", "2") for k in ("success", "fail")]
INCL_RATIOS = [f"previous_exit_result_ratio_incl{n}" for n in ("", "2")]


@query(
    "lagged_win_count_incl",
    sql(
        f"""
        SELECT ticker, date, {', '.join(INCL)}, {rs(*INCL_RATIOS)} FROM (
          SELECT *, {past('gain_loss_ratio', 'signal_incl', 1.02, 290, 30, '_incl')},
                    {past('gain_loss_ratio2', 'signal_incl', 1.01, 280, 20, '_incl2')}
          FROM exit_both JOIN (SELECT ticker AS t, bar_index AS b, signal_incl FROM sig_t) ON t = ticker AND b = bar_index)
        """,
        "exit_both", "sig_t",
    ),
)
def lagged_win_count_incl(spark: SparkSession, folder: str) -> DataFrame:
    return v.by_bar(v.on_bars(spark, folder, *tr.lagged_wins_incl()), *INCL, rounded=tuple(INCL_RATIOS))


@query(
    "funding_cost",
    sql(
        f"""
        SELECT ticker, date, CAST(days AS BIGINT) AS days, {r('factor')} AS factor,
               {r('exit_gain_loss - (factor - 1)')} AS funded_ratio
        FROM (SELECT *, pow(1 + 0.05 / 365::DOUBLE, days) AS factor
              FROM (SELECT *, date_diff('day', entry_date, exit_date) AS days FROM trades))
        """,
        "trades",
    ),
)
def funding_cost(spark: SparkSession, folder: str) -> DataFrame:
    days = F.datediff("exit_date", "entry_date").cast("bigint")
    trades = v.trades(spark, folder).withColumns({"days": days, "factor": tr.funding_factor(F.col("days"))})
    return trades.select(
        "ticker", "date", "days", v.r("factor"),
        v.single(F.col("exit_gain_loss") - (F.col("factor") - 1)).alias("funded_ratio"),
    )


@query(
    "nonoverlap_trades",
    sql(
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
def nonoverlap_trades(spark: SparkSession, folder: str) -> DataFrame:
    return series.nonoverlapping(v.trades(spark, folder), longest=tr.ExitRule().hold + 2)


@query(
    "best_per_window",
    sql(
        f"""
        SELECT month, ticker, {r('ret')} AS best_return FROM (
          SELECT *, row_number() OVER (PARTITION BY month ORDER BY ret DESC, ticker) AS n FROM (
          SELECT CAST(date_trunc('month', date) AS DATE) AS month, ticker,
                 arg_max(close, date) / arg_min(open, date) AS ret FROM bars GROUP BY 1, 2)) WHERE n = 1
        """,
        "bars",
    ),
)
def best_per_window(spark: SparkSession, folder: str) -> DataFrame:
    best = reports.best_per_month(v.bars(spark, folder))
    return best.select("month", "ticker", v.r("best_return"))


# ---- by instrument and year ----------------------------------------------------------------------

YEAR_COLUMNS = "ticker, year, trade_count, trades_won, trades_lost"


def years(df: DataFrame, *more) -> DataFrame:
    return df.select("ticker", "year", "trade_count", "trades_won", "trades_lost", v.r("avg_return"), *more)


@query("trade_year", sql(f"SELECT {YEAR_COLUMNS}, {rs('avg_return')} FROM trade_year", "trade_year"))
def trade_year(spark: SparkSession, folder: str) -> DataFrame:
    return years(v.trade_year(spark, folder))


@query(
    "year_profile",
    sql(
        f"""
        SELECT year, CAST(sum(trade_count) AS BIGINT) AS opportunities, CAST(sum(trades_won) AS BIGINT) AS success,
               CAST(sum(trades_lost) AS BIGINT) AS fail,
               {r('CAST(sum(trades_won) AS DOUBLE) / CAST(sum(trades_lost) AS DOUBLE)')} AS success_fail_ratio,
               {r('sum(avg_return * trade_count) / CAST(sum(trade_count) AS DOUBLE)')} AS avg_return_rate
        FROM trade_year GROUP BY 1
        """,
        "trade_year",
    ),
)
def year_profile(spark: SparkSession, folder: str) -> DataFrame:
    out = reports.year_profile(v.trade_year(spark, folder))
    return out.select(
        "year", "opportunities", "success", "fail", v.r("success_fail_ratio"), v.r("avg_return_rate")
    ).orderBy("year")


STORED_REVIEW = """
    SELECT `year(Date)` AS year, sum(`total trade count`) AS opportunities, sum(`trade won`) AS success, sum(`trade loss`) AS fail,
           CASE WHEN sum(`trade loss`) = 0 THEN CASE WHEN sum(`trade won`) = 0 THEN double('NaN') ELSE double('Infinity') END
                ELSE sum(`trade won`) / sum(`trade loss`) END AS success_fail_ratio,
           CASE WHEN sum(`total trade count`) = 0 THEN double('NaN')
                ELSE sum(`average trade return` * `total trade count`) / sum(`total trade count`) END AS avg_return_rate
    FROM {years} GROUP BY 1 ORDER BY 1
"""

PROFILE = """
    SELECT year, sum(trade_count) AS opportunities, sum(trades_won) AS won,
           max(avg_return) AS best_return, count(DISTINCT ticker) AS tickers
    FROM {0} GROUP BY year HAVING sum(trade_count) > 0 ORDER BY year
"""


@query(
    "sql_over_frame",
    sql(
        f"""
        SELECT year, CAST(opportunities AS BIGINT) AS opportunities, CAST(won AS BIGINT) AS won,
               {rs('best_return')}, tickers FROM ({PROFILE.format('trade_year')})
        """,
        "trade_year",
    ),
)
def sql_over_frame(spark: SparkSession, folder: str) -> DataFrame:
    out = store.sql_over(spark, PROFILE.format("{years}"), years=v.trade_year(spark, folder))
    return out.select("year", "opportunities", "won", v.r("best_return"), "tickers")


@query("win_loss_ratio", sql(f"SELECT ticker, year, {rs('win_loss_ratio')} FROM ratios", "ratios"))
def win_loss_ratio(spark: SparkSession, folder: str) -> DataFrame:
    return reports.with_win_loss(v.trade_year(spark, folder)).select("ticker", "year", v.r("win_loss_ratio"))


@query(
    "rank_by_year",
    sql(
        "SELECT ticker, year, dense_rank() OVER (PARTITION BY year ORDER BY win_loss_ratio DESC) AS drnk FROM ratios",
        "ratios",
    ),
)
def rank_by_year(spark: SparkSession, folder: str) -> DataFrame:
    return reports.ranked_by_year(v.trade_year(spark, folder)).select("ticker", "year", "drnk")


BY_YEAR = "OVER (PARTITION BY ticker ORDER BY year)"


@query(
    "prev_year_lag",
    sql(
        f"""
        SELECT ticker, year, lag(trade_count) {BY_YEAR} AS prev_trade_count,
               {r(f'lag(win_loss_ratio) {BY_YEAR}')} AS prev_win_loss_ratio FROM ratios
        """,
        "ratios",
    ),
)
def prev_year_lag(spark: SparkSession, folder: str) -> DataFrame:
    out = reports.with_previous_year(v.trade_year(spark, folder))
    return out.select("ticker", "year", "prev_trade_count", v.r("prev_win_loss_ratio"))


HISTORY = "list(win_loss_ratio) OVER (PARTITION BY ticker ORDER BY year ROWS BETWEEN {0} PRECEDING AND 1 PRECEDING)"


@query(
    "history_list",
    sql(
        f"""
        SELECT ticker, year, pos, {r('ratio')} AS ratio FROM (
          SELECT ticker, year, unnest(range(len(h))) AS pos, unnest(h) AS ratio
          FROM (SELECT *, {HISTORY.format(5)} AS h FROM ratios))
        """,
        "ratios",
    ),
)
def history_list(spark: SparkSession, folder: str) -> DataFrame:
    out = reports.with_history(v.trade_year(spark, folder))
    long = out.select("ticker", "year", F.posexplode("history").alias("pos", "ratio"))
    return long.select("ticker", "year", F.col("pos").cast("bigint").alias("pos"), v.r("ratio"))


@query(
    "consistent_history",
    sql(
        f"""
        SELECT {YEAR_COLUMNS}, {rs('avg_return')} FROM (SELECT *, {HISTORY.format(v.HISTORY)} AS h FROM ratios)
        WHERE len(h) = {v.HISTORY} AND len(list_filter(h, lambda x: x <= 1)) = 0
        """,
        "ratios",
    ),
)
def consistent_history(spark: SparkSession, folder: str) -> DataFrame:
    return years(reports.consistent_history(v.trade_year(spark, folder), v.HISTORY))


@query(
    "ratio_bin_counts",
    sql(f"SELECT {BIN_SQL} AS category, count(*) AS tally FROM ratios GROUP BY 1", "ratios"),
)
def ratio_bin_counts(spark: SparkSession, folder: str) -> DataFrame:
    return reports.bin_counts(reports.with_win_loss(v.trade_year(spark, folder)))


@query(
    "consistent_bin_counts",
    sql(
        f"""
        SELECT {BIN_SQL} AS category, count(*) AS tally FROM (SELECT *, {HISTORY.format(v.HISTORY)} AS h FROM ratios)
        WHERE len(h) = {v.HISTORY} AND len(list_filter(h, lambda x: x <= 1)) = 0 GROUP BY 1
        """,
        "ratios",
    ),
)
def consistent_bin_counts(spark: SparkSession, folder: str) -> DataFrame:
    """How instruments with consistent years before did, by win/loss ratio."""
    return reports.bin_counts(reports.consistent_history(v.trade_year(spark, folder), v.HISTORY))


@query("good_years", sql(f"SELECT {YEAR_COLUMNS}, {rs('avg_return')} FROM good", "good"))
def good_years(spark: SparkSession, folder: str) -> DataFrame:
    return years(reports.good_years(v.trade_year(spark, folder), v.LAST_YEAR))


def occurrence_counts(spark: SparkSession, folder: str) -> DataFrame:
    return reports.occurrences(reports.good_years(v.trade_year(spark, folder), v.LAST_YEAR, **v.FAIR))


@query(
    "occurrence_hist",
    sql("SELECT occurrence, count(*) AS tickers FROM occurrences GROUP BY 1", "occurrences"),
)
def occurrence_hist(spark: SparkSession, folder: str) -> DataFrame:
    return reports.occurrence_hist(occurrence_counts(spark, folder))


@query(
    "consistent_tickers",
    sql(f"SELECT ticker, occurrence FROM occurrences WHERE occurrence >= {v.ENOUGH}", "occurrences"),
)
def consistent_tickers(spark: SparkSession, folder: str) -> DataFrame:
    picked = reports.consistent_tickers(occurrence_counts(spark, folder), v.ENOUGH)
    return picked.orderBy(F.desc("occurrence"))


JOINED = f"""
    SELECT t.*, o.occurrence FROM ratios t JOIN occurrences o USING (ticker)
    WHERE o.occurrence >= {v.ENOUGH} AND t.year > {v.LAST_YEAR}
"""


@query(
    "join_qualified",
    sql(f"SELECT {YEAR_COLUMNS}, {rs('avg_return')}, occurrence FROM ({JOINED})", "ratios", "occurrences"),
)
def join_qualified(spark: SparkSession, folder: str) -> DataFrame:
    picked = reports.consistent_tickers(occurrence_counts(spark, folder), v.ENOUGH)
    return years(reports.join_qualified(v.trade_year(spark, folder), picked, v.LAST_YEAR), "occurrence")


@query(
    "prev_year_join",
    sql(
        f"""
        SELECT a.ticker, a.year, a.trade_count, b.trade_count AS prev_year_trade_count,
               {r('b.win_loss_ratio')} AS prev_year_win_loss_ratio
        FROM ratios a LEFT JOIN ratios b ON a.ticker = b.ticker AND a.year = b.year + 1 WHERE b.win_loss_ratio > 1
        """,
        "ratios",
    ),
)
def prev_year_join(spark: SparkSession, folder: str) -> DataFrame:
    out = reports.with_year_before(reports.with_win_loss(v.trade_year(spark, folder)))
    out = out.where(F.col("prev_year_win_loss_ratio") > 1)
    return out.select(
        "ticker", "year", "trade_count", "prev_year_trade_count", v.r("prev_year_win_loss_ratio")
    )


VERIFIED = f"""
    SELECT a.*, b.trade_count AS prev_year_trade_count, b.win_loss_ratio AS prev_ratio
    FROM ({JOINED}) a LEFT JOIN ({JOINED}) b ON a.ticker = b.ticker AND a.year = b.year + 1
    WHERE b.win_loss_ratio > 1
"""


@query(
    "oos_verification",
    sql(
        f"""
        SELECT {YEAR_COLUMNS}, {rs('avg_return')}, prev_year_trade_count, {r('prev_ratio')} AS prev_year_win_loss_ratio
        FROM ({VERIFIED})
        """,
        "ratios", "occurrences",
    ),
)
def oos_verification(spark: SparkSession, folder: str) -> DataFrame:
    out = reports.oos_verification(v.trade_year(spark, folder), v.LAST_YEAR, v.ENOUGH, **v.FAIR)
    return years(out, "prev_year_trade_count", v.r("prev_year_win_loss_ratio")).orderBy("ticker", "year")


@query(
    "verified_bin_counts",
    sql(f"SELECT {BIN_SQL} AS category, count(*) AS tally FROM ({VERIFIED}) GROUP BY 1", "ratios", "occurrences"),
)
def verified_bin_counts(spark: SparkSession, folder: str) -> DataFrame:
    """How the instruments picked on the reference years did afterwards, by win/loss ratio."""
    return reports.bin_counts(reports.oos_verification(v.trade_year(spark, folder), v.LAST_YEAR, v.ENOUGH, **v.FAIR))


# ---- stored yearly tables ------------------------------------------------------------------------


def stored_years(spark: SparkSession, folder: str) -> str:
    """The yearly trade tables written under the column names they are stored with."""
    path = store.fresh(spark, "trade_years")
    yearly.write_trade_years(v.trade_year(spark, folder), path)
    return path


@query("stored_trade_years", sql(f"SELECT {YEAR_COLUMNS}, {rs('avg_return')} FROM trade_year", "trade_year"))
def stored_trade_years(spark: SparkSession, folder: str) -> DataFrame:
    return years(yearly.read_trade_years(spark, stored_years(spark, folder)))


@query("stored_year_review", ORACLES["year_profile"])
def stored_year_review(spark: SparkSession, folder: str) -> DataFrame:
    """The yearly review in SQL over the stored tables, under their own column names."""
    stored = yearly.stored_frame(spark, stored_years(spark, folder))
    out = store.sql_over(spark, STORED_REVIEW, years=stored)
    return out.select("year", "opportunities", "success", "fail", v.r("success_fail_ratio"), v.r("avg_return_rate"))


@query(
    "win_loss_summary",
    sql(
        f"""
        SELECT ticker, count(*) FILTER (WHERE exit_gain_loss > 1) AS win,
               {r('avg(exit_gain_loss) FILTER (WHERE exit_gain_loss > 1)')} AS avg_win_ratio,
               count(*) FILTER (WHERE exit_gain_loss < 1) AS loss,
               {r('avg(exit_gain_loss) FILTER (WHERE exit_gain_loss < 1)')} AS avg_loss_ratio
        FROM trades GROUP BY 1
        """,
        "trades",
    ),
)
def win_loss_summary(spark: SparkSession, folder: str) -> DataFrame:
    out = reports.win_loss_summary(v.trades(spark, folder))
    return out.select("ticker", "win", v.r("avg_win_ratio"), "loss", v.r("avg_loss_ratio"))


@query(
    "yearly_consistency",
    sql(
        f"""
        SELECT ticker, count(*) AS years, count(*) FILTER (WHERE avg_return > 1) AS good_years,
               {r('count(*) FILTER (WHERE avg_return > 1) / CAST(count(*) AS DOUBLE)')} AS consistency
        FROM trade_year WHERE avg_return IS NOT NULL GROUP BY 1
        """,
        "trade_year",
    ),
)
def yearly_consistency(spark: SparkSession, folder: str) -> DataFrame:
    out = reports.yearly_consistency(v.trade_year(spark, folder))
    return out.select("ticker", "years", "good_years", v.r("consistency"))


@query(
    "rank_by_product",
    sql(
        f"""
        SELECT ticker, trade_count, {rs('product')}, dense_rank() OVER (ORDER BY product DESC) AS drnk FROM (
          SELECT ticker, count(*) AS trade_count, product(exit_gain_loss) AS product FROM trades
          WHERE exit_gain_loss IS NOT NULL GROUP BY 1)
        """,
        "trades",
    ),
)
def rank_by_product(spark: SparkSession, folder: str) -> DataFrame:
    return reports.rank_by_product(v.trades(spark, folder)).select("ticker", "trade_count", v.r("product"), "drnk")


# ---- bars ----------------------------------------------------------------------------------------


@query("tickers_per_year", sql("SELECT CAST(year(date) AS INTEGER) AS year, count(DISTINCT ticker) AS tickers FROM bars GROUP BY 1", "bars"))
def tickers_per_year(spark: SparkSession, folder: str) -> DataFrame:
    return reports.tickers_per_year(v.bars(spark, folder))


QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


@query(
    "sketch_profile",
    sql(
        f"""
        SELECT CAST(year(date) AS INTEGER) AS year, count(*) AS n_bars, count(DISTINCT ticker) AS tickers, true AS count_within,
               {', '.join(f'true AS {q}_within' for q in QUARTILES)} FROM bars GROUP BY 1
        """,
        "bars",
    ),
)
def sketch_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Yearly counts and quartiles merged from monthly sketches, held against the bars: are they within the stated errors?"""
    bars = v.bars(spark, folder).select("ticker", "date", "close")
    stored = store.kept(sketches.monthly_sketches(bars), "sketches")
    found = sketches.merged(stored, {"year": F.year("month")}, QUARTILES)
    joined = bars.withColumn("year", F.year("date")).join(found, "year")
    # how many values lie below a quantile, and how many up to it: its rank is between these shares
    share = {
        q: (F.avg((F.col("close") < F.col(q)).cast("double")), F.avg((F.col("close") <= F.col(q)).cast("double")))
        for q in QUARTILES
    }
    checks = {
        f"{q}_within": (low <= QUARTILES[q] + sketches.RANK_ERROR) & (high >= QUARTILES[q] - sketches.RANK_ERROR)
        for q, (low, high) in share.items()
    }
    exact = F.count_distinct("ticker")
    off = F.abs(F.first("instruments") - exact) <= sketches.COUNT_ERROR * exact
    return joined.groupBy("year").agg(
        F.first("n_bars").alias("n_bars"), exact.alias("tickers"), off.alias("count_within"),
        *(check.alias(name) for name, check in checks.items()),
    )


@query("value_counts", sql('SELECT exit_reason, count(*) AS "count" FROM trades GROUP BY 1', "trades"))
def value_counts(spark: SparkSession, folder: str) -> DataFrame:
    return reports.value_counts(v.trades(spark, folder), "exit_reason")


PROFILED = ["open", "high", "low", "close", "volume"]


@query(
    "column_profile",
    sql(f"SELECT count(*) AS rows, {', '.join(f'max({c}) AS max_{c}' for c in PROFILED)} FROM bars", "bars"),
)
def column_profile(spark: SparkSession, folder: str) -> DataFrame:
    return reports.column_profile(v.bars(spark, folder), PROFILED)


@query(
    "indicator_range",
    sql(
        f"""
        SELECT ticker, {r('min(tmf_w)')} AS min_value, {r('max(tmf_w)')} AS max_value,
               {r('avg(tmf_w)')} AS mean_value, {r('stddev_samp(tmf_w)')} AS std_value FROM tmf GROUP BY 1
        """,
        "tmf",
    ),
)
def indicator_range(spark: SparkSession, folder: str) -> DataFrame:
    out = reports.indicator_range(v.on_bars(spark, folder, ind.tmf()), "tmf_w")
    return out.select("ticker", *[v.r(f"{c}_value") for c in ("min", "max", "mean", "std")])


@query(
    "max_drawdown",
    sql(
        f"""
        SELECT ticker, {r('min(close / peak - 1)')} AS max_drawdown
        FROM (SELECT *, max(close) OVER (PARTITION BY ticker ORDER BY date) AS peak FROM bars) GROUP BY 1
        """,
        "bars",
    ),
)
def max_drawdown(spark: SparkSession, folder: str) -> DataFrame:
    return reports.max_drawdown(v.bars(spark, folder)).select("ticker", v.r("max_drawdown"))


@query(
    "sharpe",
    sql(
        f"""
        SELECT ticker, {r('avg(ret) / stddev_samp(ret) * sqrt(252)')} AS sharpe
        FROM (SELECT ticker, close / prev_close - 1 AS ret FROM prev) GROUP BY 1
        """,
        "prev",
    ),
)
def sharpe(spark: SparkSession, folder: str) -> DataFrame:
    out = v.on_bars(spark, folder, ind.previous_close())
    out = out.withColumn("ret", ieee_div(F.col("close"), F.col("prev_close")) - 1)
    return reports.sharpe(out).select("ticker", v.r("sharpe"))


@query(
    "annualised_return",
    sql(
        f"""
        SELECT ticker, {r("pow(arg_max(close, date) / arg_min(close, date), 365.0::DOUBLE / date_diff('day', min(date), max(date))) - 1")}
               AS annualised_return FROM bars GROUP BY 1
        """,
        "bars",
    ),
)
def annualised_return(spark: SparkSession, folder: str) -> DataFrame:
    return reports.annualised_return(v.bars(spark, folder)).select("ticker", v.r("annualised_return"))


@query(
    "hold_return",
    sql(
        f"""
        SELECT ticker, CAST(year(date) AS INTEGER) AS year, {r('arg_max(close, date) / arg_min(open, date)')} AS hold_return
        FROM bars GROUP BY 1, 2
        """,
        "bars",
    ),
)
def hold_return(spark: SparkSession, folder: str) -> DataFrame:
    return reports.hold_return(v.bars(spark, folder)).select("ticker", "year", v.r("hold_return"))


@query(
    "index_feature",
    sql(
        f"""
        SELECT b.ticker, b.date, {r('i.index_close')} AS index_close, {r('b.close / i.index_close')} AS rel_close
        FROM bars b LEFT JOIN (SELECT date, avg(close) AS index_close FROM bars GROUP BY 1) i ON b.date = i.date
        """,
        "bars",
    ),
)
def index_feature(spark: SparkSession, folder: str) -> DataFrame:
    bars = v.bars(spark, folder)
    out = reports.with_index(bars, reports.index_series(bars))
    return v.by_bar(out, rounded=("index_close", "rel_close"))
