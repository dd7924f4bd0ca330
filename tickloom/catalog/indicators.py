"""Composite indicators."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.catalog import views as v
from tickloom.catalog.registry import query
from tickloom.catalog.sql import UP_TO_NOW, ewm, fixed, last_rows, r, rs, rsi, sql, truncated
from tickloom.operators import indicators as ind
from tickloom.operators import series
from tickloom.plans.layout import BLOCK_ROWS
from tickloom.plans.steps import Step, compute


def indicator(
    name: str, body: str, base: str, steps: Callable[[], Sequence[Step]], *,
    exact: tuple[str, ...] = (), rounded: tuple[str, ...] = (), gaps: tuple[str, ...] = (),
) -> None:
    """Register a query that adds ``steps`` to the bars and compares the named columns."""

    @query(name, sql(body, base))
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return v.by_bar(v.on_bars(spark, folder, *steps()), *exact, rounded=rounded, gaps=gaps)


def signed_rsi(name: str, gain: str, loss: str, gain_sql: str, loss_sql: str, step: Callable[[], Step]) -> None:
    """Register a signed RSI with the two averages it is made of.

    Where the averages nearly cancel the index has a pole, and its value hangs on their last bits. ``own`` is the
    operator's column, null where the sum of the averages is below a thousandth of the loss. So that the others can
    be compared too, the column shown under the name is worked out from the averages to eight decimals.
    """
    g, l = f"round({gain}, 8)", f"round({loss}, 8)"
    body = f"""
        SELECT ticker, date, {rs(gain, loss)}, {r(rsi(g, l))} AS {name},
               CASE WHEN abs({g} + {l}) > 0.001 * abs({l}) THEN {r(rsi(gain, loss))} END AS own
        FROM (SELECT *, {gain_sql} AS {gain}, {loss_sql} AS {loss} FROM chg)
    """

    @query("rsi_sma" if name == "rsi" else name, sql(body, "chg"))
    def run(spark: SparkSession, folder: str) -> DataFrame:
        out = v.on_bars(spark, folder, step())
        up, down = F.col(gain), F.col(loss)
        g, l = F.round(up, 8), F.round(down, 8)
        own = F.when(F.abs(g + l) > 0.001 * F.abs(l), v.single(F.col(name))).alias("own")
        return out.select("ticker", "date", v.r(gain), v.r(loss), v.single(ind.signed_rsi(g, l)).alias(name), own)


# ---- trend ---------------------------------------------------------------------------------

indicator(
    "macd", f"SELECT ticker, date, {fixed('(' + ewm('close', 11) + ') - (' + ewm('close', 25) + ')')} AS macd FROM idx",
    "idx", lambda: [ind.macd()], gaps=("macd",),
)
MACD_STD = f"({truncated('close', 12, 'standard')}) - ({truncated('close', 26, 'standard')})"
indicator(
    "macd_standard", f"SELECT ticker, date, {fixed(MACD_STD)} AS macd_standard FROM idx",
    "idx", lambda: [ind.macd_standard()], gaps=("macd_standard",),
)
indicator(
    "macd_signal",
    f"""
    SELECT ticker, date, {fixed(truncated('m', 9, 'standard'))} AS macd_signal
    FROM (SELECT *, {MACD_STD} AS m FROM idx)
    """,
    "idx", lambda: [ind.macd_signal()], gaps=("macd_signal",),
)

# ---- strength --------------------------------------------------------------------------------

signed_rsi(
    "rsi", "rsi_avg_gain", "rsi_avg_loss", f"avg(gain) {last_rows(14)}", f"avg(loss) {last_rows(14)}",
    lambda: ind.rsi_sma(),
)
signed_rsi(
    "rsi_incl", "rsi_incl_avg_gain", "rsi_incl_avg_loss",
    f"avg(gain) {last_rows(15)}", f"avg(loss) {last_rows(15)}", lambda: ind.rsi_sma(15, "rsi_incl"),
)
signed_rsi("rsi_ewm", "ema_gain", "ema_loss", ewm("gain", 13), ewm("loss", 13), lambda: ind.rsi_ewm())
signed_rsi(
    "rsi_truncated", "ema_gain_t", "ema_loss_t",
    truncated("gain", 14, "wilder"), truncated("loss", 14, "wilder"), lambda: ind.rsi_truncated(),
)


def seeded(x: str) -> str:
    """Textbook smoothing as a growing-weight sum: the seed bar holds the first fourteen changes."""
    z = f"CASE WHEN bar_index < 15 THEN 0 WHEN bar_index = 15 THEN s_{x} ELSE {x} END"
    return f"sum(({z}) * pow(14.0::DOUBLE / 13, bar_index)) {UP_TO_NOW}"


indicator(
    "rsi_wilder",
    f"""
    SELECT ticker, date, {r('CASE WHEN bar_index >= 15 THEN CASE WHEN g + l = 0 THEN 0 ELSE 100 * g / (g + l) END END')} AS rsi_wilder
    FROM (SELECT *, {seeded('up')} AS g, {seeded('down')} AS l
    FROM (SELECT *, sum(up) {last_rows(14)} AS s_up, sum(down) {last_rows(14)} AS s_down
    FROM (SELECT *, greatest(close - prev_close, 0) AS up, greatest(prev_close - close, 0) AS down FROM prev)))
    """,
    "prev", lambda: [ind.rsi_wilder()], rounded=("rsi_wilder",),
)

# ---- range -----------------------------------------------------------------------------------

indicator("true_range", "SELECT ticker, date, tr FROM ranges", "ranges", lambda: [ind.true_range()], exact=("tr",))
indicator("atr", f"SELECT ticker, date, {rs('atr')} FROM atrs", "atrs", lambda: [ind.atr()], rounded=("atr",))
indicator(
    "natr", f"SELECT ticker, date, {r('100 * atr / close')} AS natr FROM atrs", "atrs", lambda: [ind.natr()], rounded=("natr",),
)
indicator(
    "antr", f"SELECT ticker, date, {r(f'avg(100 * tr / prev_close) {last_rows(14)}')} AS antr FROM ranges",
    "ranges", lambda: [ind.antr()], rounded=("antr",),
)
indicator(
    "directional_movement", "SELECT ticker, date, up, dn, pdm, ndm FROM moves", "moves",
    lambda: [ind.directional_movement()], exact=("up", "dn", "pdm", "ndm"),
)
indicator(
    "adx", f"SELECT ticker, date, up, dn, {rs('pdi', 'ndi', 'adx')} FROM adx", "adx",
    lambda: [ind.adx()], exact=("up", "dn"), rounded=("pdi", "ndi", "adx"),
)
indicator(
    "supertrend_bands", f"SELECT ticker, date, {rs('st_up_diff_norm', 'st_lo_diff_norm')} FROM bands", "bands",
    lambda: [ind.supertrend_bands()], rounded=("st_up_diff_norm", "st_lo_diff_norm"),
)


@query(
    "supertrend_recursive",
    sql(
        f"""
        basic AS MATERIALIZED (SELECT *, (high + low) / 2 + 2 * atr AS bu, (high + low) / 2 - 2 * atr AS bl FROM atrs),
        st AS (
          SELECT ticker, date, bar_index, close, bu AS ub, bl AS lb, 1 AS direction FROM basic WHERE bar_index = 1
          UNION ALL
          SELECT b.ticker, b.date, b.bar_index, b.close,
                 CASE WHEN b.bu < s.ub OR s.close > s.ub THEN b.bu ELSE s.ub END,
                 CASE WHEN b.bl > s.lb OR s.close < s.lb THEN b.bl ELSE s.lb END,
                 CASE WHEN b.close > s.ub THEN 1 WHEN b.close < s.lb THEN -1 ELSE s.direction END
          FROM st s JOIN basic b ON b.ticker = s.ticker AND b.bar_index = s.bar_index + 1)
        SELECT ticker, date, {r('ub')} AS upperband, {r('lb')} AS lowerband, direction FROM st
        """,
        "atrs", recursive=True,
    ),
)
def supertrend_recursive(spark: SparkSession, folder: str) -> DataFrame:
    out = series.supertrend_recursive(compute(v.bars(spark, folder), ind.atr(), block=BLOCK_ROWS, blocks=True), 2)
    return v.by_bar(out, "direction", rounded=("upperband", "lowerband"))


# ---- volume ------------------------------------------------------------------------------------

indicator("accum_dist", "SELECT ticker, date, ad FROM flow", "flow", lambda: [ind.accum_dist()], exact=("ad",))
indicator("tmf", f"SELECT ticker, date, {rs('tmf_w')} FROM tmf", "tmf", lambda: [ind.tmf()], rounded=("tmf_w",))
indicator(
    "tmf_truncated", f"SELECT ticker, date, {rs('tmf_t')} FROM tmf_t", "tmf_t", lambda: [ind.tmf_truncated()],
    rounded=("tmf_t",),
)
FLOORS = ("tmf_4w_min", "tmf_4w_min_dd", "tmf_26w_min", "tmf_26w_min_dd")
indicator(
    "tmf_floor", f"SELECT ticker, date, {rs(*FLOORS)} FROM floors", "floors", ind.tmf_floor, rounded=FLOORS,
)
FLOORS_T = tuple(c.replace("tmf_", "tmf_t_") for c in FLOORS)
indicator(
    "tmf_floor_incl", f"SELECT ticker, date, {rs(*FLOORS_T)} FROM floors_t", "floors_t", ind.tmf_floor_incl,
    rounded=FLOORS_T,
)
MEDIANS = tuple(f"tmf_{f}_min_dd_qtl_50{a}" for f in ("4w", "26w") for a in ("", "_alt"))
indicator(
    "tmf_floor_medians", f"SELECT ticker, date, {rs(*MEDIANS)} FROM medians", "medians",
    lambda: [ind.tmf_floor_medians()], rounded=MEDIANS,
)
MEDIANS_T = tuple(c.replace("tmf_", "tmf_t_") for c in MEDIANS)


def lower_pair(dd: str, out: str) -> str:
    falls, over = f"CASE WHEN {dd} < 0 THEN {dd} END", last_rows(521)
    return f"quantile_cont({falls}, 0.5) {over} AS {out}, quantile_disc({falls}, 0.5) {over} AS {out}_alt"


indicator(
    "tmf_floor_medians_incl",
    f"""
    SELECT ticker, date, {rs(*MEDIANS_T)} FROM (
      SELECT *, {lower_pair('tmf_t_4w_min_dd', 'tmf_t_4w_min_dd_qtl_50')},
                {lower_pair('tmf_t_26w_min_dd', 'tmf_t_26w_min_dd_qtl_50')} FROM floors_t)
    """,
    "floors_t", lambda: [ind.tmf_floor_medians_incl()], rounded=MEDIANS_T,
)
indicator("tmf_signal", "SELECT ticker, date, signal FROM sig", "sig", lambda: [ind.tmf_signal()], exact=("signal",))
indicator(
    "tmf_signal_incl", "SELECT ticker, date, signal_incl FROM sig_t", "sig_t", lambda: [ind.tmf_signal_incl()],
    exact=("signal_incl",),
)
SIGN = "CASE WHEN tmf_26w_min_dd <> 0 THEN sign(tmf_26w_min_dd) END"
indicator(
    "dd_sign_count",
    f"SELECT ticker, date, CAST(sum({SIGN}) {last_rows(21)} AS DOUBLE) AS dd_sign_count FROM floors",
    "floors", lambda: [ind.dd_sign_count()], exact=("dd_sign_count",),
)


def gap_sql(x: str) -> str:
    return fixed(f"{x} - quantile_cont({x}, 0.5) {last_rows(130)}")


indicator(
    "percentile_gap",
    f"""
    SELECT ticker, date, {gap_sql('tmf_w')} AS tmf_gap, {gap_sql('macd')} AS macd_gap
    FROM (SELECT *, ({ewm('close', 11)}) - ({ewm('close', 25)}) AS macd FROM tmf)
    """,
    "tmf",
    lambda: [
        ind.percentile_gap("tmf_w", 130, "tmf_gap", (ind.tmf(),)),
        ind.percentile_gap("macd", 130, "macd_gap", (ind.macd(),)),
    ],
    gaps=("tmf_gap", "macd_gap"),
)
