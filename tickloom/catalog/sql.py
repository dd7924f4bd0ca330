"""Building blocks of the comparison SQL: the views again, as common table expressions."""

from __future__ import annotations

from tickloom.functions.smoothing import Smoothing, lookback_of

W = "PARTITION BY ticker ORDER BY bar_index"


def frame(first: int, last: int = 0) -> str:
    """OVER clause from ``first`` to ``last`` bars around the current one (negative: before)."""

    def end(n: int) -> str:
        if n == 0:
            return "CURRENT ROW"
        return f"{abs(n)} {'PRECEDING' if n < 0 else 'FOLLOWING'}"

    return f"OVER ({W} ROWS BETWEEN {end(first)} AND {end(last)})"


def last_rows(n: int) -> str:
    return frame(-(n - 1))


OVER = f"OVER ({W})"
UP_TO_NOW = f"OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def r(x: str) -> str:
    """A computed value in single precision, so that the order of a sum does not show.

    Rounding to decimals would not do: means of decimal prices often lie exactly between
    two of them. Eleven decimals first: sums that cancel agree to no more than about 1e-14 of their largest part.
    """
    return f"CAST(CAST(round({x}, 11) AS FLOAT) AS DOUBLE) + 0.0"


def rs(*names: str) -> str:
    return ", ".join(f"{r(n)} AS {n}" for n in names)


def fixed(x: str) -> str:
    """A difference of close values, to six decimals: its leading digits have cancelled."""
    return f"round({x}, 6) + 0.0"


def ewm(x: str, com: float) -> str:
    w = f"pow(CAST({(1 + com)} AS DOUBLE) / {com}, bar_index)"
    mean = (
        f"sum(({x}) * {w}) {UP_TO_NOW} / "
        f"sum(CASE WHEN ({x}) IS NOT NULL THEN {w} END) {UP_TO_NOW}"
    )
    return f"CASE WHEN ({x}) IS NOT NULL THEN {mean} END"


def truncated(x: str, period: int, kind: str) -> str:
    s, back = Smoothing.of(period, kind), lookback_of(period, kind)
    values = f"list({x}) FILTER (WHERE ({x}) IS NOT NULL) {frame(-back)}"
    total = (
        f"list_sum(list_transform({values}, lambda v, i: v * "
        f"CASE WHEN i = 1 THEN {s.decay**back!r} ELSE {s.weight!r} * pow({s.decay!r}, {back + 1} - i) END))"
    )
    return f"CASE WHEN len({values}) = {back + 1} THEN {total} END"


def rsi(gain: str, loss: str) -> str:
    return f"100 - 100.0 / (1 + ({gain}) / ({loss}))"


TYPICAL = "(open + high + low + close) / 4"
ATR = f"avg(tr) {last_rows(14)}"

VIEWS: dict[str, tuple[str, str]] = {}


def view(name: str, base: str, sql: str) -> None:
    VIEWS[name] = (base, sql)


view(
    "bars", "",
    """
    SELECT l_suppkey AS ticker, CAST(l_shipdate AS DATE) AS date,
           arg_min(p, k) AS open, max(p * (1 + l_tax / 10)) AS high,
           min(p * (1 - l_discount / 10)) AS low,
           arg_max(p * (1 + (l_tax - l_discount) / 10), k) AS close,
           CAST(sum(l_quantity) AS DOUBLE) AS volume
    FROM (SELECT *, 100 * (1 + (l_extendedprice - 50000) / 1e6) AS p,
                 row(l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS k FROM lineitem)
    GROUP BY 1, 2
    """,
)
view("idx", "bars", "SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS bar_index FROM bars")
view("prev", "idx", f"SELECT *, lag(close) {OVER} AS prev_close FROM idx")
view(
    "ranges", "prev",
    "SELECT *, greatest(high - low, abs(high - prev_close), abs(low - prev_close)) AS tr FROM prev",
)
view("atrs", "ranges", f"SELECT *, {ATR} AS atr FROM ranges")
view(
    "flow", "prev",
    """
    SELECT *, (2 * close - trh - trl) / (trh - trl + 1e-11) * volume AS ad
    FROM (SELECT *, greatest(high, prev_close) AS trh, least(low, prev_close) AS trl FROM prev)
    """,
)
view("tmf", "flow", f"SELECT *, ({ewm('ad', 13)}) / ({ewm('volume', 13)}) AS tmf_w FROM flow")
view(
    "floors", "tmf",
    f"""
    SELECT *, tmf_4w_min - lag(tmf_4w_min) {OVER} AS tmf_4w_min_dd,
              tmf_26w_min - lag(tmf_26w_min) {OVER} AS tmf_26w_min_dd
    FROM (SELECT *, min(tmf_w) {last_rows(20)} AS tmf_4w_min,
                    min(tmf_w) {last_rows(130)} AS tmf_26w_min FROM tmf)
    """,
)


def median_pair(dd: str, rows: int, out: str) -> str:
    falls = f"CASE WHEN {dd} < 0 THEN {dd} END"
    ordered = f"list_sort(list({dd}) FILTER (WHERE {dd} < 0) {last_rows(rows)})"
    return (
        f"quantile_cont({falls}, 0.5) {last_rows(rows)} AS {out}, "
        f"{ordered}[len({ordered}) // 2 + 1] AS {out}_alt"
    )


view(
    "medians", "floors",
    f"""
    SELECT *, {median_pair('tmf_4w_min_dd', 20, 'tmf_4w_min_dd_qtl_50')},
              {median_pair('tmf_26w_min_dd', 130, 'tmf_26w_min_dd_qtl_50')}
    FROM floors
    """,
)
SIGNAL = f"CASE WHEN {{0}} = 0 AND lag({{0}}) {OVER} < 0 THEN 1 ELSE 0 END"
view("sig", "floors", f"SELECT *, {SIGNAL.format('tmf_26w_min_dd')} AS signal FROM floors")
AHEAD = frame(1, 12)
EXITS = f"""
    SELECT *, exit_price / entry_price AS exit_gain_loss, bar_index + 1 + exit_point AS exit_bar,
           CASE WHEN exit_point IS NULL THEN NULL WHEN gain_at + 1 = exit_point THEN 'gain'
                WHEN loss_at + 1 = exit_point THEN 'loss' ELSE 'period' END AS exit_reason
    FROM (SELECT *, lx[exit_point + 1] AS exit_price, ld[exit_point + 1] AS exit_date
    FROM (SELECT *, CASE WHEN entry_price IS NOT NULL THEN CAST(least(gain_at, loss_at, 10) + 1 AS BIGINT) END AS exit_point
    FROM (SELECT *,
            list_position(list_transform(lc, lambda x: x / entry_price > 1.05), true) - 1 AS gain_at,
            list_position(list_transform(lc, lambda x: x / entry_price < 0.95), true) - 1 AS loss_at
    FROM (SELECT *, CASE WHEN len(lc) = 12 THEN lx[1] END AS entry_price,
                    CASE WHEN len(lc) = 12 THEN ld[1] END AS entry_date
    FROM (SELECT *, list(close) {AHEAD} AS lc, list({TYPICAL}) {AHEAD} AS lx, list(date) {AHEAD} AS ld
          FROM {{0}})))))
    """
view("outcomes", "sig", EXITS.format("sig"))
view("trades", "outcomes", "SELECT * FROM outcomes WHERE signal = 1")
view(
    "trade_year", "trades",
    """
    SELECT ticker, CAST(year(date) AS INTEGER) AS year, avg(exit_gain_loss) AS avg_return,
           count(exit_gain_loss) AS trade_count,
           count(*) FILTER (WHERE exit_gain_loss > 1) AS trades_won,
           count(*) FILTER (WHERE exit_gain_loss < 1) AS trades_lost
    FROM trades GROUP BY 1, 2
    """,
)
view(
    "ratios", "trade_year",
    """
    SELECT *, CAST(trades_won AS DOUBLE) / CAST(trades_lost AS DOUBLE) AS win_loss_ratio
    FROM trade_year
    """,
)
view(
    "good", "ratios",
    "SELECT * FROM ratios WHERE avg_return >= 1.05 AND win_loss_ratio > 2 AND year <= 1998",
)
view(
    "occurrences", "ratios",
    """
    SELECT ticker, count(*) AS occurrence FROM ratios
    WHERE avg_return >= 1.0 AND win_loss_ratio > 1.0 AND year <= 1998 GROUP BY 1
    """,
)
view(
    "preds", "",
    """
    SELECT CAST(l_shipdate AS DATE) AS date, 0.90::DOUBLE + 2 * l_discount AS y_true,
           0.92::DOUBLE + 2 * l_tax AS y_pred FROM lineitem
    """,
)
view("chg", "idx", """
    SELECT *, CASE WHEN chg > 0 THEN chg ELSE 0 END AS gain, CASE WHEN chg <= 0 THEN chg ELSE 0 END AS loss
    FROM (SELECT *, close / open - 1 AS chg FROM idx)
    """)
view(
    "moves", "atrs",
    f"""
    SELECT *, CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END AS pdm,
              CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0 END AS ndm
    FROM (SELECT *, high - lag(high) {OVER} AS up, lag(low) {OVER} - low AS dn FROM atrs)
    """,
)
view(
    "adx", "moves",
    f"""
    SELECT *, {ewm('dx', 13)} AS adx FROM (
    SELECT *, CASE WHEN isnan(dx0) THEN 0 ELSE dx0 END AS dx FROM (
    SELECT *, abs(pdi - ndi) / abs(pdi + ndi) AS dx0 FROM (
    SELECT *, CASE WHEN atr <> 0 THEN ({ewm('pdm', 13)}) / atr END AS pdi,
              CASE WHEN atr <> 0 THEN ({ewm('ndm', 13)}) / atr END AS ndi FROM moves)))
    """,
)


def bands(base: str, period: int = 14, multiplier: float = 2) -> str:
    full = last_rows(period)
    return f"""
    SELECT *, CASE WHEN atr <> 0 THEN st_upper_band / atr END AS st_up_diff_norm,
              CASE WHEN atr <> 0 THEN st_lower_band / atr END AS st_lo_diff_norm FROM (
    SELECT *, CASE WHEN count(b_up) {full} = {period} THEN min(b_up) {full} END AS st_upper_band,
              CASE WHEN count(b_lo) {full} = {period} THEN max(b_lo) {full} END AS st_lower_band FROM (
    SELECT *, lag((high + low) / 2 + {multiplier} * atr) {OVER} AS b_up,
              lag((high + low) / 2 - {multiplier} * atr) {OVER} AS b_lo FROM {base}))
    """


view("bands", "atrs", bands("atrs"))
view(
    "caps", "idx",
    f"""
    SELECT *, sum(cap_xchgd_approx) {last_rows(261)} AS yearly_cap_xchngd,
              stddev_samp(log_vol) {last_rows(261)} AS std_vol,
              stddev_samp(log_cap) {last_rows(261)} AS std_cap FROM (
    SELECT *, log10(volume + 1) AS log_vol, log10(cap_xchgd_approx + 100) AS log_cap FROM (
    SELECT *, volume * greatest(open + high + low + close / 4, 0) AS cap_xchgd_approx FROM idx))
    """,
)


def past(ratio: str, signal: str, threshold: float, first: int, last: int, tag: str) -> str:
    f = frame(-first, -last)
    won = f"count(*) FILTER (WHERE {ratio} > {threshold} AND {signal} = 1) {f}"
    lost = f"count(*) FILTER (WHERE {ratio} <= {threshold} AND {signal} = 1) {f}"
    return (
        f"{won} AS previous_exit_success{tag}, {lost} AS previous_exit_fail{tag}, "
        f"({won}) / CAST(({lost}) + 1 AS DOUBLE) AS previous_exit_result_ratio{tag}"
    )


view("past", "outcomes", f"SELECT *, {past('exit_gain_loss', 'signal', 1.02, 289, 30, '')} FROM outcomes")


def signal_bar_exit(base: str, hold: int, gain: float, loss: float, tag: str) -> str:
    return f"""
    SELECT *, exit_slip_price{tag} / next_entry_price - 0.002 AS gain_loss_ratio{tag} FROM (
    SELECT *, lm{tag}[exit_index{tag} + 1] AS exit_slip_price{tag} FROM (
    SELECT *, CAST(list_position(list_transform(lc{tag}, lambda x, i:
        coalesce(x / next_entry_price > {gain} OR x / next_entry_price < {loss}, false) OR i = {hold + 1}), true) + 1 AS BIGINT)
        AS exit_index{tag} FROM (
    SELECT *, list(close) {frame(0, hold + 1)} AS lc{tag},
              list((high + low) / 2) {frame(0, hold + 3)} AS lm{tag} FROM {base})))
    """


NEXT = f"SELECT *, lead({TYPICAL}) {OVER} AS next_entry_price, lead(open) {OVER} AS buy_price FROM {{0}}"
view("next_entry", "idx", NEXT.format("idx"))
view("exit_wide", "next_entry", signal_bar_exit("next_entry", 20, 1.1, 0.9, ""))
view("exit_both", "exit_wide", signal_bar_exit("exit_wide", 10, 1.05, 0.95, "2"))
view(
    "tmf_t", "flow",
    f"""
    SELECT *, ({truncated('ad', 14, 'wilder')}) / ({truncated('volume', 14, 'wilder')}) AS tmf_t FROM flow
    """,
)
view(
    "floors_t", "tmf_t",
    f"""
    SELECT *, tmf_t_4w_min - lag(tmf_t_4w_min) {OVER} AS tmf_t_4w_min_dd,
              tmf_t_26w_min - lag(tmf_t_26w_min) {OVER} AS tmf_t_26w_min_dd
    FROM (SELECT *, min(tmf_t) {last_rows(21)} AS tmf_t_4w_min,
                    min(tmf_t) {last_rows(131)} AS tmf_t_26w_min FROM tmf_t)
    """,
)
view("sig_t", "floors_t", f"SELECT *, {SIGNAL.format('tmf_t_26w_min_dd')} AS signal_incl FROM floors_t")
view(
    "features", "medians,outcomes,past,adx,bands,caps",
    """
    SELECT m.ticker, m.date, m.tmf_w, m.tmf_4w_min, m.tmf_4w_min_dd, m.tmf_26w_min, m.tmf_26w_min_dd,
           m.tmf_4w_min_dd_qtl_50, m.tmf_4w_min_dd_qtl_50_alt,
           m.tmf_26w_min_dd_qtl_50, m.tmf_26w_min_dd_qtl_50_alt,
           CAST(p.previous_exit_success AS DOUBLE) AS previous_exit_success, p.previous_exit_result_ratio,
           a.pdi, a.ndi, a.adx, b.st_up_diff_norm, b.st_lo_diff_norm,
           log10(c.yearly_cap_xchngd + 100) AS log_year_cap, c.std_vol, c.log_vol, c.std_cap, c.log_cap,
           CAST(dayofweek(m.date) AS DOUBLE) AS day_of_week, p.exit_gain_loss, p.exit_gain_loss AS target
    FROM past p JOIN medians m USING (ticker, bar_index) JOIN adx a USING (ticker, bar_index)
         JOIN bands b USING (ticker, bar_index) JOIN caps c USING (ticker, bar_index)
    WHERE p.signal = 1
    """,
)


def sql(body: str, *views: str, recursive: bool = False, instead: dict[str, str] | None = None) -> str:
    """``body`` with the named views, and those below them, in front of it; ``instead`` gives some another text."""
    instead = instead or {}
    needed: list[str] = []

    def visit(name: str) -> None:
        if not name or name in needed:
            return
        for base in VIEWS[name][0].split(","):
            visit(base)
        needed.append(name)

    for name in views:
        visit(name)
    parts = ", ".join(f"{n} AS MATERIALIZED ({instead.get(n, VIEWS[n][1]).strip()})" for n in needed)
    word = "WITH RECURSIVE" if recursive else "WITH"
    if recursive:
        return f"{word} {parts}, {body.strip()}" if parts else f"{word} {body.strip()}"
    return f"{word} {parts} {body.strip()}" if parts else body.strip()
