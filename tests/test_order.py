"""Quantiles of sliding frames."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as some
from pyspark.sql import functions as F

from conftest import series
from tickloom.functions.order import KINDS, SlidingOrder
from tickloom.operators import windows
from tickloom.plans import steps
from tickloom.plans.steps import Quantile, compute

VALUE = some.one_of(some.none(), some.integers(-3, 3).map(float), some.just(float("nan")))


def plain(values, bars, fraction, kind):
    """Every frame sorted anew."""
    out = []
    for i in range(len(values)):
        frame = [v for v in values[max(0, i - bars + 1) : i + 1] if v is not None]
        frame.sort(key=lambda v: (v != v, v))
        if not frame:
            out.append(None)
            continue
        place = fraction * (len(frame) - 1)
        low = int(place)
        if kind == "linear":
            part = place - low
            out.append(frame[low] + (frame[low + 1] - frame[low]) * part if part else frame[low])
        elif kind == "nearest":
            out.append(frame[int(place + 0.5)])
        else:
            out.append(next(v for k, v in enumerate(frame, 1) if k >= fraction * len(frame)))
    return out


@settings(max_examples=150, deadline=None)
@given(some.lists(VALUE, max_size=40), some.integers(1, 50), some.sampled_from([0.0, 0.25, 0.5, 0.75, 1.0]), some.sampled_from(KINDS))
def test_against_sorted_frames(values, bars, fraction, kind):
    absent = np.array([v is None for v in values], bool)
    given_values = np.array([0.0 if v is None else v for v in values], float)
    found, empty = SlidingOrder(given_values, absent).quantiles([(9, 0.5, "linear"), (bars, fraction, kind)])[1]
    got = [None if e else v for v, e in zip(found, empty)]
    assert got == pytest.approx(plain(values, bars, fraction, kind), nan_ok=True)


def test_unknown_kind():
    with pytest.raises(ValueError):
        SlidingOrder(np.zeros(1), np.zeros(1, bool)).quantiles([(3, 0.5, "middle")])


@pytest.mark.parametrize(("block", "short"), [(None, 130), (64, 0), (64, 1000)])
def test_blocks_nulls_and_order_of_steps(spark, monkeypatch, block, short):
    """Frames longer than a block, absent values, and quantiles of quantiles."""
    monkeypatch.setattr(steps, "SHORT_FRAME", short)
    draw = np.random.default_rng(1)
    closes = [None if draw.random() < 0.2 else float(draw.integers(0, 30)) for _ in range(400)]
    bars = series(spark, [(t, d, c) for t in (1, 2) for d, c in enumerate(closes)])
    first = windows.rolling_quantiles(
        "first", Quantile("m", F.col("close"), 150), Quantile("up", F.col("close"), 9, 0.75, "lower")
    )
    change = windows.simple("turn", "turn", lambda w: F.col("m") - F.lag("m").over(w), 1, needs=(first,))
    second = windows.rolling_quantiles("second", Quantile("mm", F.col("turn"), 5, 0.5, "nearest"), needs=(change,))
    out = compute(bars, second, block=block).where("ticker = 2").toPandas().sort_values("bar_index")
    m = plain(closes, 150, 0.5, "linear")
    turn = [None] + [None if a is None or b is None else b - a for a, b in zip(m, m[1:])]
    expected = {"m": m, "up": plain(closes, 9, 0.75, "lower"), "mm": plain(turn, 5, 0.5, "nearest")}
    for name, values in expected.items():
        pd.testing.assert_series_equal(
            out[name].reset_index(drop=True), pd.Series(values, dtype=float), check_names=False
        )


def test_empty_table(spark):
    bars = series(spark, [(1, 0, 1.0)]).where("ticker = 2")
    assert compute(bars, windows.rolling_quantiles("q", Quantile("m", F.col("close"), 300))).collect() == []
