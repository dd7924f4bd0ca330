"""Long rolling windows from short ones.

A frame that slides over n bars is evaluated anew for every row, which costs n steps a
row. Here the result over 7, 49, ... bars comes from seven results over a seventh as many, the
earlier ones fetched with lags, so a row costs some log n steps. Nothing is ever subtracted, so
no digits cancel, and a NaN goes no further than its own window.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

Parts = Mapping[str, Column]

#: Results put together in one pass over the rows. A pass costs about as much as the lags of a few columns, so two would be too few.
AT_ONCE = 7


@dataclass(frozen=True)
class Track:
    """A rolling result made of parts: over one bar, over two runs of bars, and in the end.

    The earlier run, ``b``, may be missing, with all its parts NULL.
    """

    one: Parts
    both: Callable[[Parts, Parts], Parts]
    result: Callable[[Parts], Column]


def total(value: Column) -> Track:
    def both(a: Parts, b: Parts) -> Parts:
        return {"sum": F.coalesce(a["sum"] + b["sum"], a["sum"], b["sum"])}

    return Track({"sum": value}, both, lambda p: p["sum"])


def spread_samp(value: Column) -> Track:
    """Sample standard deviation, from counts, means and sums of squared distances."""

    def both(a: Parts, b: Parts) -> Parts:
        count = a["n"] + b["n"]
        gap = b["mean"] - a["mean"]
        share = F.try_divide(b["n"], count)
        return {
            "n": F.coalesce(count, a["n"]),
            "mean": F.coalesce(a["mean"] + gap * share, a["mean"], b["mean"]),
            "m2": F.coalesce(a["m2"] + b["m2"] + gap * gap * a["n"] * share, a["m2"], b["m2"]),
        }

    one = {
        "n": F.when(value.isNotNull(), 1.0).otherwise(0.0),
        "mean": value,
        "m2": F.when(value.isNotNull(), 0.0),
    }
    return Track(
        one, both, lambda p: F.when(p["n"] > 1, F.sqrt(F.try_divide(p["m2"], p["n"] - 1)))
    )


def sliding(
    tracks: Mapping[str, Track], count: int, window: WindowSpec, tag: str
) -> list[dict[str, Column]]:
    """Layers that add, for each name, the result over the last ``count`` bars.

    All tracks go through the same passes. Parts are columns of their own, and lags and
    sums separate layers, so that no expression is repeated inside the next one.
    """

    def column(name: str, part: str, level: object) -> str:
        return f"_{tag}_{name}_{part}_{level}"

    def at(name: str, level: object) -> Parts:
        return {p: F.col(column(name, p, level)) for p in tracks[name].one}

    def fetch(wanted: Sequence[tuple[int, int]]) -> dict[str, Column]:
        """The parts of each (level, bars ago)."""
        return {
            column(n, p, f"{level}_{back}"): F.lag(column(n, p, level), back).over(window)
            for level, back in wanted
            for n, t in tracks.items()
            for p in t.one
        }

    def joined(run: list[object], into: object) -> Iterator[dict[str, Column]]:
        """Neighbouring runs of bars, the newest first, put together two at a time."""
        turn = 0
        while len(run) > 1:
            pairs = [run[i : i + 2] for i in range(0, len(run), 2)]
            made = {i: f"{into}_{turn}_{i}" if len(pairs) > 1 else into for i, pair in enumerate(pairs) if len(pair) == 2}
            yield {
                column(n, p, name): c
                for i, name in made.items()
                for n, t in tracks.items()
                for p, c in t.both(at(n, pairs[i][0]), at(n, pairs[i][1])).items()
            }
            run, turn = [made.get(i, pair[0]) for i, pair in enumerate(pairs)], turn + 1

    def longer(level: int, wanted: Sequence[tuple[int, int]], into: object) -> list[dict[str, Column]]:
        return [fetch(wanted), *joined([level, *[f"{at}_{back}" for at, back in wanted]], into)]

    layers = [{column(n, p, 0): c for n, t in tracks.items() for p, c in t.one.items()}]
    held: object = 0
    top, covered = 0, 1
    while covered * AT_ONCE <= count:
        layers += longer(top, [(top, k * covered) for k in range(1, AT_ONCE)], top + 1)
        top, covered = top + 1, covered * AT_ONCE
        held = top
    rest = []
    for level in reversed(range(top + 1)):
        while covered + AT_ONCE**level <= count:
            rest.append((level, covered))
            covered += AT_ONCE**level
    if rest:
        layers += longer(top, rest, "all")
        held = "all"
    layers.append({n: t.result(at(n, held)) for n, t in tracks.items()})
    return layers


def least_of(source: str, out: str, count: int, window: WindowSpec) -> list[dict[str, Column]]:
    """Layers that add the least value of the last ``count`` bars; NULL takes no part, NaN is largest.

    Frames of about the root of ``count`` bars are evaluated, and the least of this one and of earlier ones is taken:
    two roots a row instead of ``count``.
    """
    short = math.isqrt(count)
    part = f"_{out}_short"
    backs = sorted({*range(short, count - short, short), count - short} - {0})
    near = F.min(source).over(window.rowsBetween(-(short - 1), 0))
    if not backs:
        return [{out: near}]
    return [
        {part: near},
        {f"{part}_{back}": F.lag(part, back).over(window) for back in backs},
        {out: F.least(part, *[f"{part}_{back}" for back in backs])},
    ]


def counted(
    conditions: Mapping[str, Column], first: int, last: int, window: WindowSpec, tag: str
) -> list[dict[str, Column]]:
    """Layers that count, for each name, the bars ``first`` .. ``last`` before the current one
    that meet a condition.

    The difference of two running counts; whole numbers lose nothing in it.
    """
    running = window.rowsBetween(Window.unboundedPreceding, 0)
    upto = {f"_{tag}_{n}": F.count(F.when(c, 1)).over(running) for n, c in conditions.items()}

    def before(name: str, back: int) -> Column:
        return F.coalesce(F.lag(f"_{tag}_{name}", back).over(window), F.lit(0))

    # Whatever lies before the start of the block is in neither running count.
    return [upto, {n: before(n, last) - before(n, first + 1) for n in conditions}]
