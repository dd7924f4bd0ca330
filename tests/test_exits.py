"""Exits watched from the signal bar: against plain lists, and without a list for every row."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from conftest import series
from tickloom.operators import trades as tr
from tickloom.plans.layout import index_bars
from tickloom.plans.steps import compute
from tickloom.sources import bars as src

INF, NAN = math.inf, math.nan


def divided(a, b):
    """As ``ieee_div``; NaN counts as the largest value."""
    if a is None or b is None:
        return None
    if b == 0:
        return INF if a > 0 or a != a else -INF if a < 0 else NAN
    return a / b


def above(x, bound):
    return x is not None and (x != x or x > bound)


def by_lists(bars, rule):
    """(exit index, slip price) of each bar, from the lists of what is there."""
    out = []
    for t in range(len(bars)):
        ahead = bars[t + 1] if t + 1 < len(bars) else [None] * 4
        entry = None if None in ahead else sum(ahead[1:], ahead[0]) / 4
        closes = [b[3] for b in bars[t : t + rule.hold + 2] if b[3] is not None]
        middles = [(b[1] + b[2]) / 2 for b in bars[t : t + rule.hold + 4] if b[1] is not None and b[2] is not None]
        ratios = [divided(c, entry) for c in closes]
        places = [k for k, x in enumerate(ratios) if above(x, rule.gain) or (x is not None and x < rule.loss)][:1]
        if len(closes) > rule.hold:
            places.append(rule.hold)
        index = min(places) + 2 if places else None
        out.append((index, middles[index] if index is not None and index < len(middles) else None))
    return out


def odd_bars(seed, count=300):
    """Bars of a quiet and a wild series with missing, zero, NaN and infinite prices; some runs of closes are missing."""
    odds = random.Random(seed)
    bars, price = [], 100.0
    for n in range(count):
        price *= 1 + odds.uniform(-0.02, 0.02) * (1 + seed % 2 * 2)
        row = [price * (1 + odds.uniform(-0.01, 0.01)) for _ in range(4)]
        for k in range(4):
            u = odds.random()
            if u < 0.08 or (k == 3 and n % 97 < 14):
                row[k] = None
            elif u < 0.10:
                row[k] = odds.choice([0.0, -0.0, NAN, INF, -price])
        if n % 53 == 0:
            row = [0.0] * 4
        bars.append(row)
    return bars


def same(a, b):
    return a == b or (a is not None and b is not None and (a != a and b != b or math.isclose(a, b, rel_tol=1e-14)))


@pytest.mark.parametrize("seed", range(2))
def test_exits_are_those_of_lists(spark, seed):
    bars = odd_bars(seed)
    rows = [(1, n + 1, *bar) for n, bar in enumerate(bars)]
    df = spark.createDataFrame(rows, "ticker bigint, bar_index bigint, open double, high double, low double, close double")
    for block in (None, 64):
        out = compute(df, tr.exit_from_signal_bar(tr.WIDE), tr.exit_from_signal_bar(tr.NARROW, "2"), block=block)
        got = out.orderBy("bar_index").collect()
        for rule, tag in ((tr.WIDE, ""), (tr.NARROW, "2")):
            for row, (index, slip) in zip(got, by_lists(bars, rule), strict=True):
                assert row[f"exit_index{tag}"] == index, row
                assert same(row[f"exit_slip_price{tag}"], slip), row
    assert out.schema["exit_index"].dataType.typeName() == "long"


def test_signal_bar_exits_build_no_lists_and_share_one_pass(bars):
    out = compute(bars, tr.exit_from_signal_bar(tr.WIDE), tr.exit_from_signal_bar(tr.NARROW, "2"))
    text = out._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in text and len(re.findall(r"\bWindow \[", text)) == 1
    assert not re.search(r"lambda", text)


def test_short_rules_and_ends(spark):
    rule = tr.ExitRule(1, 1.5, 0.5)
    out = compute(series(spark, [(1, day, 10.0) for day in range(6)]), tr.exit_from_signal_bar(rule)).orderBy("bar_index")
    assert [(r.exit_index, r.exit_slip_price) for r in out.collect()] == [(3, 10.0)] * 3 + [(3, None)] * 2 + [(None, None)]


# ---- bars ----------------------------------------------------------------------------------------


def lines(spark, count=3000, days=400):
    odds = random.Random(5)
    rows = []
    for n in range(count):
        day = None if odds.random() < 0.02 else odds.randrange(-days // 2, days)
        supplier = None if odds.random() < 0.02 else odds.choice([1, 1, 1, 2, 3, odds.randrange(40)])
        rows.append((n // 4, n % 4, n % 7, supplier, day, float(odds.randrange(1, 50)), odds.uniform(1e3, 9e4), 0.05, 0.02))
    schema = (
        "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, day int, "
        "l_quantity double, l_extendedprice double, l_discount double, l_tax double"
    )
    df = spark.createDataFrame(rows + rows[:50], schema)
    return df.withColumn("l_shipdate", F.date_add(F.lit("1970-01-01").cast("date"), "day").cast("timestamp_ntz"))


@pytest.mark.parametrize("span_days", [7, 64, 128])
def test_days_are_counted_as_the_bars(spark, span_days):
    """Also before 1970, where lines come twice, and where suppliers and dates are missing."""
    data = lines(spark)
    made = src.shipment_bars(data, span_days)
    want = made.groupBy("ticker", "_span").agg(F.count(F.lit(1)).alias("_bars"))
    counts = src.shipment_days(data, span_days)
    got, want = (sorted(map(tuple, x.collect()), key=str) for x in (counts, want))
    assert got == want
    numbered = index_bars(made, span=F.col("_span"), counts=counts)
    plain = index_bars(made, span=F.col("_span"))
    assert numbered.columns == plain.columns
    assert sorted(map(tuple, numbered.collect())) == sorted(map(tuple, plain.collect()))


def test_bars_are_sorted_once(spark):
    data = lines(spark)
    made = index_bars(src.shipment_bars(data, 128), span=F.col("_span"), counts=src.shipment_days(data, 128))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = made._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # one for the bars; the runs are sorted for their running sum and for the join
    assert len(re.findall(r"\bSort \[", text)) == 3
    assert "partial_bit_or" in text
