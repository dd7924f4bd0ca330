"""Whole-series results per instrument: recursive bands, position keeping, returns, slices."""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.numeric import ieee_div
from tickloom.plans.layout import BLOCK_ROWS, POSITION, block_keys
from tickloom.plans.scan import MAX, PRODUCT, Machine, follow, running

# ---- recursive Supertrend ------------------------------------------------------------
#
# The upper band keeps its value while it lies between the previous close and the new
# basic band, and takes the basic band otherwise. As a function of the value a block is
# entered with, a run of such steps leaves an inner interval as it is and maps everything
# left and right of it, in pieces, to constants. The lower band is the same with signs
# turned.


def _keep(value: float, floor: float, basic: float) -> float:
    return value if floor <= value <= basic else basic


# A close beyond a band turns the direction. A band that a run of steps leaves as it is ends at the next step when the
# close goes beyond it, since that close is the next floor. So a value can be crossed in the step that
# ends it and in the one before it, and the constants it goes over to are the same for all values that end there.
# A piece: cut point, constant, bar of the last crossing of the constants (0 for none), bar that ends the values, its close,
# and the close before it.
_CUT, _TO, _LAST, _AT, _HERE, _BEFORE = range(6)
_NEVER = float("-inf")


def _band_pieces(places: list[int], closes: list[float], floors: list[float], basics: list[float]) -> dict:
    """The map of a whole run: cut points and constants left and right of the interval, and their crossings."""
    left, right = [], []
    low, high = float("-inf"), float("inf")
    # Bands that took the same basic band go on as one; a track is its value, last crossing, and the one it ended in.
    tracks: list[list] = []
    for place, close, floor, basic in zip(places, closes, floors, basics):
        ended = False
        for track in tracks:
            if close > track[0]:
                track[1] = place
            if not floor <= track[0] <= basic:
                ended = True
        cut_left = low <= high and floor > low
        cut_right = low <= high and basic < high
        if not (ended or cut_left or cut_right):
            continue
        one = [basic, 0, None]
        for track in tracks:
            if not floor <= track[0] <= basic:
                track[2] = one
        tracks = [track for track in tracks if track[2] is None] + [one]
        here = _NEVER if place == 1 else close
        before = _NEVER if place == places[0] else floor
        if cut_left:
            low = floor
            left.append((floor, one, place, here, before))
        if cut_right:
            high = basic
            right.append((basic, one, place, here, before))
    ends = {"left": [_piece(*p) for p in left], "right": [_piece(*p) for p in right]}
    return {**ends, "first": places[0], "end": places[-1], "tail": closes[-1]}


def _piece(cut: float, track: list, place: int, here: float, before: float) -> list[float]:
    last = 0
    while True:
        last = track[1] or last  # a later track's crossing is the later one
        if track[2] is None:
            return [float(v) for v in (cut, track[0], last, place, here, before)]
        track = track[2]


def _through(run: dict, value: float) -> tuple[float, float]:
    """Where a run takes an entry value, and the bar of its last crossing (0 for none)."""
    left, right = run["left"], run["right"]
    piece = None
    if len(left) and value < left[-1][_CUT]:
        piece = left[bisect_right(left, value, key=lambda p: p[_CUT])]
    elif len(right) and value > right[-1][_CUT]:
        piece = right[bisect_right(right, -value, key=lambda p: -p[_CUT])]
    if piece is None:
        return value, float(run["end"]) if run["tail"] > value else 0.0
    last = piece[_AT] if piece[_HERE] > value else piece[_AT] - 1 if piece[_BEFORE] > value else 0.0
    return float(piece[_TO]), float(piece[_LAST] or last)


def _both(first: dict, second: dict) -> dict:
    """One run after another."""

    def on(pieces: list) -> list:
        found = []
        for p in pieces:
            to, last = _through(second, p[_TO])
            found.append([float(p[_CUT]), to, last or float(p[_LAST]), *map(float, p[_AT:])])
        return found

    def later(p: list) -> list:
        """A piece of the second run, for values the first one leaves: its last close comes before the second's first."""
        before = first["tail"] if p[_AT] == second["first"] else p[_BEFORE]
        return [*map(float, p[:_BEFORE]), float(before)]

    left, right = on(first["left"]), on(first["right"])
    low = left[-1][_CUT] if left else float("-inf")
    high = right[-1][_CUT] if right else float("inf")
    if low <= high:
        left += [later(p) for p in second["left"] if p[_CUT] > low]
        right += [later(p) for p in second["right"] if p[_CUT] < high]
    return {"left": left, "right": right, "first": first["first"], "end": second["end"], "tail": second["tail"]}


_SIDES = ("up", "lo")
_RUN = {"left": "array<array<double>>", "right": "array<array<double>>", "first": "bigint", "end": "bigint", "tail": "double"}


def _side(summary: dict, side: str) -> dict:
    return {p: summary[f"{side}_{p}"] for p in _RUN}


def _named(side: str, run: dict) -> dict:
    return {f"{side}_{p}": run[p] for p in _RUN}


def _band_inputs(columns: dict) -> tuple[list[float], list[float], list[float], list[float]]:
    """Closes before and basic bands; the first bar of a series always takes its basic band."""
    first = columns[POSITION][0] == 1
    before = columns["prev_close"]
    above, below = list(before), [-c if c is not None else c for c in before]
    if first:
        above[0] = below[0] = float("inf")
    return above, columns["_basic_up"], below, [-b for b in columns["_basic_lo"]]


def _bands_summary(columns: dict) -> dict:
    floor_up, basic_up, floor_lo, basic_lo = _band_inputs(columns)
    places, closes = columns[POSITION], columns["close"]
    return {
        **_named("up", _band_pieces(places, closes, floor_up, basic_up)),
        **_named("lo", _band_pieces(places, [-c for c in closes], floor_lo, basic_lo)),
    }


def _bands_compose(first: dict, second: dict) -> dict:
    out: dict = {}
    for side in _SIDES:
        out.update(_named(side, _both(_side(first, side), _side(second, side))))
    return out


def _bands_enter(summary: dict, state: dict) -> dict:
    up, above = _through(_side(summary, "up"), state["up"])
    low, below = _through(_side(summary, "lo"), -state["lo"])
    way = int(state["way"]) if not above and not below else 1 if above >= below else -1
    return {"up": up, "lo": -low, "way": way}


def _bands_run(columns: dict, state: dict) -> dict:
    up, low, way = state["up"], -state["lo"], int(state["way"])
    upper, lower, ways = [], [], []
    steps = zip(columns["close"], columns[POSITION], *_band_inputs(columns))
    for close, place, floor_up, basic_up, floor_lo, basic_lo in steps:
        if place != 1:
            way = 1 if close > up else -1 if -close > low else way
        up = _keep(up, floor_up, basic_up)
        low = _keep(low, floor_lo, basic_lo)
        upper.append(up)
        lower.append(-low)
        ways.append(way)
    out = {n: columns[n] for n in ("ticker", "date", POSITION, "close")}
    return {**out, "upperband": upper, "lowerband": lower, "direction": ways}


def supertrend_recursive(
    with_atr: DataFrame, multiplier: float = 3, block: int = BLOCK_ROWS, group: int = 1024
) -> DataFrame:
    """Carried bands and the direction (1 up, -1 down) kept until a band is crossed.

    Needs the columns of the ATR step. The direction starts at 1. Rows that ``compute`` has left in blocks of this
    size are not exchanged again.
    """
    placed = block_keys()[1] in with_atr.columns
    middle, width = (F.col("high") + F.col("low")) / 2, F.col("atr")
    # Days as whole numbers: Spark's dates go far beyond the year 9999, where those of Python end.
    daily = with_atr.schema["date"].dataType.typeName() == "date"
    moment = F.unix_date("date").alias("date") if daily else F.col("date")
    rows = with_atr.select(
        *(block_keys() if placed else ["ticker"]), moment, POSITION, "close", "prev_close",
        (middle + multiplier * width).alias("_basic_up"),
        (middle - multiplier * width).alias("_basic_lo"),
    )
    key = with_atr.schema["ticker"].dataType.simpleString()
    machine = Machine(
        start={"up": 0.0, "lo": 0.0, "way": 1},
        inputs=["date", "close", "prev_close", "_basic_up", "_basic_lo"],
        state_schema="up double, lo double, way int",
        summary_schema=", ".join(f"{s}_{p} {kind}" for s in _SIDES for p, kind in _RUN.items()),
        output_schema=(
            f"ticker {key}, date {'int' if daily else 'date'}, {POSITION} bigint, close double, "
            "upperband double, lowerband double, direction int"
        ),
        summarise=_bands_summary,
        compose=_bands_compose,
        enter=_bands_enter,
        run=_bands_run,
    )
    bands = follow(rows, machine, block=block, group=group, placed=placed)
    return bands.withColumn("date", F.date_from_unix_date("date")) if daily else bands


# ---- positions that do not overlap -----------------------------------------------------


def nonoverlapping(
    signals: DataFrame, longest: int, block: int = BLOCK_ROWS, group: int = 1024
) -> DataFrame:
    """Mark the signals that can be taken when one position is held at a time.

    ``signals`` has ``bar_index`` and ``exit_bar``; a signal is taken if its bar is not
    before the exit of the last one taken. ``longest`` bounds exit_bar - bar_index, so a
    block is left, at most, that many bars busy, and one entry per such state describes it.
    """
    key = signals.schema["ticker"].dataType.simpleString()

    def free_after(bars: list[int], exits: list[int], free: int) -> int:
        for bar, end in zip(bars, exits):
            if bar >= free:
                free = end
        return free

    def summarise(columns: dict) -> dict:
        first = int(columns["_b"][0]) * block + 1
        bars, exits = columns[POSITION], columns["exit_bar"]
        return {
            "first": first,
            "free": [free_after(bars, exits, first + k) for k in range(longest + 1)],
        }

    def enter(summary: dict, state: dict) -> dict:
        late = max(int(state["free_at"]) - int(summary["first"]), 0)
        return {"free_at": int(summary["free"][late])}

    def compose(first: dict, second: dict) -> dict:
        return {
            "first": first["first"],
            "free": [enter(second, {"free_at": f})["free_at"] for f in first["free"]],
        }

    def run(columns: dict, state: dict) -> dict:
        free, taken = int(state["free_at"]), []
        for bar, end in zip(columns[POSITION], columns["exit_bar"]):
            taken.append(bar >= free)
            if bar >= free:
                free = end
        return {**{n: columns[n] for n in ("ticker", POSITION, "exit_bar")}, "taken": taken}

    machine = Machine(
        start={"free_at": 0},
        inputs=["exit_bar"],
        state_schema="free_at bigint",
        summary_schema="first bigint, free array<bigint>",
        output_schema=f"ticker {key}, {POSITION} bigint, exit_bar bigint, taken boolean",
        summarise=summarise,
        compose=compose,
        enter=enter,
        run=run,
    )
    rows = signals.select("ticker", POSITION, "exit_bar").where(F.col("exit_bar").isNotNull())
    return follow(rows, machine, block=block, group=group)


# ---- returns and slices ----------------------------------------------------------------


def cumulative_return(trades: DataFrame, ratio: str = "exit_gain_loss") -> DataFrame:
    """Running product of trade ratios per instrument; ``trade_no`` numbers its trades."""
    return running(trades, F.col(ratio), "cumulative_return", PRODUCT, position="trade_no")


def drawdown(bars: DataFrame, price: str = "close") -> DataFrame:
    """Price against its highest value so far, minus 1."""
    peak = running(bars, F.col(price), "peak", MAX)
    return peak.withColumn("drawdown", ieee_div(F.col(price), F.col("peak")) - 1)


def positional_slice(indexed: DataFrame, start: int, stop: int, key: str = "ticker") -> DataFrame:
    """Rows ``start:stop`` of every series, counted from 0; negative places count from the end."""
    sizes = indexed.groupBy(key).agg(F.max(POSITION).alias("_size"))
    rows = indexed.join(sizes, key)

    def place(at: int):
        return F.lit(at) if at >= 0 else F.greatest(F.col("_size") + at, F.lit(0))

    here = F.col(POSITION) - 1
    return rows.where((here >= place(start)) & (here < place(stop))).drop("_size")
