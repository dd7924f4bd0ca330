"""Technical indicators as steps on a bar table (ticker, date, open, high, low, close, volume)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickloom.functions import smoothing as sm
from tickloom.functions.numeric import ieee_div, nan_to
from tickloom.functions.sliding import least_of, sliding, spread_samp, total
from tickloom.operators.windows import (
    YEAR_FRAME,
    full_window,
    rolling_quantiles,
)
from tickloom.plans.layout import POSITION, rows
from tickloom.plans.steps import Quantile, Step

# Periods and window lengths in bars.
FAST, SLOW, SIGNAL = 12, 26, 9
SMOOTH = 14
MONTH_BARS, HALF_YEAR_BARS = 4 * 5, 26 * 5
TWO_YEARS_BARS = 52 * 5 * 2
ZERO_RANGE = 1e-11


# ---- smoothing -----------------------------------------------------------------------


def ewm(column: str, com: float, out: str, needs: tuple[Step, ...] = ()) -> Step:
    """Exact adjusted exponentially weighted mean of a column."""
    return Step(
        f"ewm:{column}:{com}:{out}",
        lambda w: [{out: sm.ewm(F.col(column), com, w)}],
        needs,
        back=sm.ewm_reach(com),
        span=sm.ewm_span(com),
    )


def ema_truncated(
    column: str, period: int, kind: str, out: str, needs: tuple[Step, ...] = (),
    period_as_lookback: bool = False,
) -> Step:
    """Average over a fixed look-back, from running sums."""
    return Step(
        f"ema_truncated:{column}:{period}:{kind}:{period_as_lookback}:{out}",
        lambda w: sm.truncated_layers(column, period, kind, out, w, period_as_lookback),
        needs,
        back=sm.lookback_of(period, kind, period_as_lookback) + 1,
        span=sm.truncated_span(period, kind),
    )


def ema_truncated_fold(
    column: str, period: int, kind: str, out: str, period_as_lookback: bool = False
) -> Step:
    """The same by folding lists of values."""
    return Step(
        f"ema_truncated_fold:{column}:{period}:{kind}:{period_as_lookback}:{out}",
        lambda w: [{out: sm.truncated_ema(F.col(column), period, kind, w, period_as_lookback)}],
        back=sm.lookback_of(period, kind, period_as_lookback),
    )


def ema_lag_sum(column: str, period: int, kind: str, out: str, period_as_lookback: bool = False) -> Step:
    return Step(
        f"ema_lag_sum:{column}:{period}:{kind}:{period_as_lookback}:{out}",
        lambda w: [{out: sm.lagged_ema(column, period, kind, w, period_as_lookback)}],
        back=sm.lookback_of(period, kind, period_as_lookback),
    )


def ema_mean_tail(column: str, period: int, kind: str, out: str, period_as_lookback: bool = False) -> Step:
    mean = f"_{out}_mean"
    return Step(
        f"ema_mean_tail:{column}:{period}:{kind}:{period_as_lookback}:{out}",
        lambda w: [
            {mean: F.avg(column).over(rows(w, period + 1))},
            {out: sm.mean_tail_ema(column, mean, period, kind, w, period_as_lookback)},
        ],
        back=max(sm.lookback_of(period, kind, period_as_lookback), period + 1),
    )


# ---- trend ---------------------------------------------------------------------------


def macd(fast: int = FAST, slow: int = SLOW) -> Step:
    """Difference of two exact averages of the close, with Wilder weights 1/period."""
    return Step(
        f"macd:{fast}:{slow}",
        lambda w: [{"macd": F.col("ema_fast") - F.col("ema_slow")}],
        (ewm("close", fast - 1, "ema_fast"), ewm("close", slow - 1, "ema_slow")),
    )


def macd_standard(fast: int = FAST, slow: int = SLOW) -> Step:
    """Difference of two truncated averages with weights 2/(period+1)."""
    return Step(
        f"macd_standard:{fast}:{slow}",
        lambda w: [{"macd_standard": F.col("ema_std_fast") - F.col("ema_std_slow")}],
        (
            ema_truncated("close", fast, "standard", "ema_std_fast"),
            ema_truncated("close", slow, "standard", "ema_std_slow"),
        ),
    )


def macd_signal(period: int = SIGNAL) -> Step:
    return ema_truncated(
        "macd_standard", period, "standard", "macd_signal", needs=(macd_standard(),)
    )


# ---- strength ------------------------------------------------------------------------


def change_split() -> Step:
    """Change within the bar, split into a gain and a loss; the loss keeps its sign."""
    change = ieee_div(F.col("close"), F.col("open")) - 1
    return Step(
        "change_split",
        lambda w: [
            {"chg": change},
            {
                "gain": F.when(F.col("chg") > 0, F.col("chg")).otherwise(0.0),
                "loss": F.when(F.col("chg") <= 0, F.col("chg")).otherwise(0.0),
            },
        ],
    )


def signed_rsi(gain: Column, loss: Column) -> Column:
    """RSI with losses below zero: the ratio is negative and the index has a pole at -1."""
    return 100 - ieee_div(F.lit(100.0), 1 + ieee_div(gain, loss))


def rsi_sma(count: int = SMOOTH, out: str = "rsi") -> Step:
    return Step(
        f"rsi_sma:{count}:{out}",
        lambda w: [
            {
                f"{out}_avg_gain": F.avg("gain").over(rows(w, count)),
                f"{out}_avg_loss": F.avg("loss").over(rows(w, count)),
            },
            {out: signed_rsi(F.col(f"{out}_avg_gain"), F.col(f"{out}_avg_loss"))},
        ],
        (change_split(),),
        back=count - 1,
    )


def rsi_ewm(period: int = SMOOTH) -> Step:
    com = period - 1
    return Step(
        f"rsi_ewm:{period}",
        lambda w: [{"rsi_ewm": signed_rsi(F.col("ema_gain"), F.col("ema_loss"))}],
        (
            ewm("gain", com, "ema_gain", (change_split(),)),
            ewm("loss", com, "ema_loss", (change_split(),)),
        ),
    )


def rsi_truncated(period: int = SMOOTH) -> Step:
    return Step(
        f"rsi_truncated:{period}",
        lambda w: [{"rsi_truncated": signed_rsi(F.col("ema_gain_t"), F.col("ema_loss_t"))}],
        (
            ema_truncated("gain", period, "wilder", "ema_gain_t", (change_split(),)),
            ema_truncated("loss", period, "wilder", "ema_loss_t", (change_split(),)),
        ),
    )


def rsi_wilder(period: int = SMOOTH) -> Step:
    """Textbook RSI: close-to-close changes, seeded by the mean of the first ``period``.

    avg(t) = (avg(t-1) * (period - 1) + x(t)) / period is a decaying sum in which the
    seed bar counts with the sum of the first changes, so running sums are enough.
    """
    com = period - 1
    seed = period + 1

    def pieces(w):
        change = F.col("close") - F.lag("close").over(w)
        place = F.col(POSITION)
        first = rows(w, period)

        def seeded(column: str) -> Column:
            return (
                F.when(place < seed, 0.0)
                .when(place == seed, F.sum(column).over(first))
                .otherwise(F.col(column))
            )

        up, down = F.col("_up_sum"), F.col("_down_sum")
        return [
            {"_change": change},
            {
                "_up": F.greatest(F.col("_change"), F.lit(0.0)),
                "_down": F.greatest(-F.col("_change"), F.lit(0.0)),
            },
            {"_up_seeded": seeded("_up"), "_down_seeded": seeded("_down")},
            {
                "_up_sum": sm.ewm_sum(F.col("_up_seeded"), com, w),
                "_down_sum": sm.ewm_sum(F.col("_down_seeded"), com, w),
            },
            {
                "rsi_wilder": F.when(
                    place >= seed,
                    F.when(up + down == 0, 0.0).otherwise(100 * F.try_divide(up, up + down)),
                )
            },
        ]

    return Step(
        f"rsi_wilder:{period}", pieces, back=period + 1 + sm.ewm_reach(com), span=sm.ewm_span(com)
    )


# ---- range ---------------------------------------------------------------------------


def previous_close() -> Step:
    return Step("previous_close", lambda w: [{"prev_close": F.lag("close").over(w)}], back=1)


def true_range() -> Step:
    """Largest of the three ranges; on the first bar only high - low exists."""
    high, low, before = F.col("high"), F.col("low"), F.col("prev_close")
    return Step(
        "true_range",
        lambda w: [{"tr": F.greatest(high - low, F.abs(high - before), F.abs(low - before))}],
        (previous_close(),),
    )


def atr(period: int = SMOOTH, out: str = "atr") -> Step:
    return Step(
        f"atr:{period}:{out}",
        lambda w: [{out: F.avg("tr").over(rows(w, period))}],
        (true_range(),),
        back=period - 1,
    )


def natr(period: int = SMOOTH) -> Step:
    """Average true range as a percentage of the close."""
    return Step(
        f"natr:{period}",
        lambda w: [{"natr": 100 * ieee_div(F.col("atr"), F.col("close"))}],
        (atr(period),),
    )


def antr(period: int = SMOOTH) -> Step:
    """Mean of the true range as a percentage of the previous close."""
    return Step(
        f"antr:{period}",
        lambda w: [
            {"ntr": 100 * ieee_div(F.col("tr"), F.col("prev_close"))},
            {"antr": F.avg("ntr").over(rows(w, period))},
        ],
        (true_range(),),
        back=period - 1,
    )


def directional_movement() -> Step:
    up, dn = F.col("up"), F.col("dn")
    return Step(
        "directional_movement",
        lambda w: [
            {
                "up": F.col("high") - F.lag("high").over(w),
                "dn": F.lag("low").over(w) - F.col("low"),
            },
            {
                "pdm": F.when((up > dn) & (up > 0), up).otherwise(0.0),
                "ndm": F.when((dn > up) & (dn > 0), dn).otherwise(0.0),
            },
        ],
        back=1,
    )


def adx(period: int = SMOOTH) -> Step:
    """Directional indices and their smoothed distance; DX is a share, not a percentage."""
    com = period - 1
    pdi, ndi, width = F.col("pdi"), F.col("ndi"), F.col("atr")
    moves = directional_movement()
    indices = Step(
        f"directional_indices:{period}",
        lambda w: [
            {
                "pdi": F.when(width != 0, F.try_divide(F.col("ema_pdm"), width)),
                "ndi": F.when(width != 0, F.try_divide(F.col("ema_ndm"), width)),
            },
            {"dx": nan_to(ieee_div(F.abs(pdi - ndi), F.abs(pdi + ndi)), 0.0)},
        ],
        (atr(period), ewm("pdm", com, "ema_pdm", (moves,)), ewm("ndm", com, "ema_ndm", (moves,))),
    )
    return ewm("dx", com, "adx", (indices,))


def supertrend_bands(atr_period: int = SMOOTH, multiplier: float = 2) -> Step:
    """Previous bars' bands, tightened over a full window, in units of the average range."""
    middle, width = (F.col("high") + F.col("low")) / 2, F.col("atr")

    def pieces(w):
        return [
            {"_band_up": middle + multiplier * width, "_band_lo": middle - multiplier * width},
            {"_band_up": F.lag("_band_up").over(w), "_band_lo": F.lag("_band_lo").over(w)},
            {
                "st_upper_band": full_window(F.col("_band_up"), atr_period, F.min, w),
                "st_lower_band": full_window(F.col("_band_lo"), atr_period, F.max, w),
            },
            {
                "st_up_diff_norm": F.when(width != 0, F.try_divide(F.col("st_upper_band"), width)),
                "st_lo_diff_norm": F.when(width != 0, F.try_divide(F.col("st_lower_band"), width)),
            },
        ]

    return Step(
        f"supertrend_bands:{atr_period}:{multiplier}", pieces, (atr(atr_period),), back=atr_period
    )


# ---- volume --------------------------------------------------------------------------


def capital_traded() -> Step:
    """Traded capital, approximately. Only the close is divided by four; this is intended."""
    price = F.col("open") + F.col("high") + F.col("low") + F.col("close") / 4
    return Step(
        "capital_traded",
        lambda w: [{"cap_xchgd_approx": F.col("volume") * F.greatest(price, F.lit(0.0))}],
    )


def accum_dist() -> Step:
    """Where the close lies in the true range, times volume."""
    top, bottom = F.col("trh"), F.col("trl")
    return Step(
        "accum_dist",
        lambda w: [
            {
                "trh": F.greatest("high", "prev_close"),
                "trl": F.least("low", "prev_close"),
            },
            {
                "ad": (2 * F.col("close") - top - bottom)
                / (top - bottom + ZERO_RANGE)
                * F.col("volume")
            },
        ],
        (previous_close(),),
    )


def tmf(period: int = SMOOTH) -> Step:
    """Twiggs money flow, exact smoothing."""
    com = period - 1
    return Step(
        f"tmf:{period}",
        lambda w: [{"tmf_w": ieee_div(F.col("ema_ad"), F.col("ema_volume"))}],
        (ewm("ad", com, "ema_ad", (accum_dist(),)), ewm("volume", com, "ema_volume")),
    )


def tmf_truncated(period: int = SMOOTH) -> Step:
    """Twiggs money flow, truncated smoothing."""
    return Step(
        f"tmf_truncated:{period}",
        lambda w: [{"tmf_t": ieee_div(F.col("ema_ad_t"), F.col("ema_volume_t"))}],
        (
            ema_truncated("ad", period, "wilder", "ema_ad_t", (accum_dist(),)),
            ema_truncated("volume", period, "wilder", "ema_volume_t"),
        ),
    )


def _floor(source: str, prefix: str, bars: int, out: str, needs: tuple[Step, ...]) -> Step:
    """Rolling minimum and its change from the bar before."""
    low, dd = f"{prefix}_{out}_min", f"{prefix}_{out}_min_dd"
    return Step(
        f"floor:{source}:{prefix}:{out}:{bars}",
        lambda w: [
            *least_of(source, low, bars, w),
            {dd: F.col(low) - F.lag(low).over(w)},
        ],
        needs,
        back=bars,
    )


def tmf_floor() -> tuple[Step, Step]:
    """Money-flow floor over four and over twenty-six weeks."""
    return (
        _floor("tmf_w", "tmf", MONTH_BARS, "4w", (tmf(),)),
        _floor("tmf_w", "tmf", HALF_YEAR_BARS, "26w", (tmf(),)),
    )


def tmf_floor_incl() -> tuple[Step, Step]:
    """The same on truncated smoothing, with one more bar in each window."""
    return (
        _floor("tmf_t", "tmf_t", MONTH_BARS + 1, "4w", (tmf_truncated(),)),
        _floor("tmf_t", "tmf_t", HALF_YEAR_BARS + 1, "26w", (tmf_truncated(),)),
    )


def _falls(column: str) -> Column:
    return F.when(F.col(column) < 0, F.col(column))


def _fall_medians(stem: str, frames: dict[str, int], other: str) -> tuple[Quantile, ...]:
    """Interpolated median of the falls of each floor, and the median of kind ``other``."""
    return tuple(
        Quantile(f"{stem}_{f}_min_dd_qtl_50{mark}", _falls(f"{stem}_{f}_min_dd"), bars, 0.5, kind)
        for f, bars in frames.items()
        for mark, kind in (("", "linear"), ("_alt", other))
    )


def tmf_floor_medians() -> Step:
    """Medians of the falls of both floors: interpolated, and the upper middle."""
    medians = _fall_medians("tmf", {"4w": MONTH_BARS, "26w": HALF_YEAR_BARS}, "nearest")
    return rolling_quantiles("tmf_floor_medians", *medians, needs=tmf_floor())


def tmf_floor_medians_incl() -> Step:
    """Two-year medians of the falls, interpolated and lower middle, truncated smoothing."""
    frame = TWO_YEARS_BARS + 1
    medians = _fall_medians("tmf_t", {"4w": frame, "26w": frame}, "lower")
    return rolling_quantiles("tmf_floor_medians_incl", *medians, needs=tmf_floor_incl())


def _turn(dd: str, out: str, needs: tuple[Step, ...]) -> Step:
    """1 on the first bar on which the floor has stopped falling."""
    return Step(
        out,
        lambda w: [
            {
                out: F.when((F.col(dd) == 0) & (F.lag(dd).over(w) < 0), 1).otherwise(0),
            }
        ],
        needs,
        back=1,
    )


def tmf_signal() -> Step:
    return _turn("tmf_26w_min_dd", "signal", tmf_floor()[1:])


def tmf_signal_incl() -> Step:
    return _turn("tmf_t_26w_min_dd", "signal_incl", tmf_floor_incl()[1:])


def dd_sign_count(bars: int = MONTH_BARS + 1) -> Step:
    """Sum of the signs of the floor's changes; unchanged bars count as missing."""
    dd = F.col("tmf_26w_min_dd")
    sign = F.try_divide(dd, F.abs(dd))
    return Step(
        f"dd_sign_count:{bars}",
        lambda w: [{"dd_sign_count": F.sum(sign).over(rows(w, bars))}],
        tmf_floor()[1:],
        back=bars - 1,
    )


def percentile_gap(column: str, bars: int, out: str, needs: tuple[Step, ...]) -> Step:
    """A value minus its own rolling median."""
    median = Quantile(f"_{out}_median", F.col(column), bars)
    return Step(
        f"percentile_gap:{column}:{bars}:{out}",
        lambda w: [{out: F.col(column) - F.col(median.out)}],
        needs,
        back=bars - 1,
        quantiles=(median,),
    )


def yearly_capital() -> Step:
    """Capital over the last year's bars, and spread of log volume and log capital."""
    log_volume = F.log10(F.col("volume") + 1)
    log_cap = F.log10(F.col("cap_xchgd_approx") + 100)
    return Step(
        "yearly_capital",
        lambda w: [
            {"log_vol": log_volume, "log_cap": log_cap},
            *sliding(
                {
                    "yearly_cap_xchngd": total(F.col("cap_xchgd_approx")),
                    "std_vol": spread_samp(F.col("log_vol")),
                    "std_cap": spread_samp(F.col("log_cap")),
                },
                YEAR_FRAME, w, "year",
            ),
        ],
        (capital_traded(),),
        back=YEAR_FRAME - 1,
    )
