"""How a bar table is spread over tasks.

Windows over a whole instrument put that instrument into one task, so one
instrument with a large share of the rows would hold up the job. Here every
instrument is cut into blocks of consecutive bars instead. A block also gets
copies of the bars just before and after it, as many as the look-back and
look-ahead of the columns to be computed, and the copies are dropped again at
the end. All rolling columns then share one exchange on (ticker, block).

``bar_index`` numbers the bars of an instrument from 1. It is found in two
steps: bars are counted per (ticker, span of days), the counts are summed up
along the few spans of a ticker, and bars are numbered inside each span.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tickloom.functions.numeric import idiv

BLOCK_ROWS = 4096
SPAN_DAYS = 1024

POSITION = "bar_index"
_BLOCK, _OFFSET, _CORE = "_block", "_offset", "_core"
LAYOUT = (_BLOCK, _OFFSET, _CORE)


def index_bars(
    bars: DataFrame, key: str = "ticker", time: str = "date", span: Column | None = None,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Add ``bar_index``: 1, 2, ... per instrument in time order.

    ``span`` maps the time to a coarse, order-keeping bucket of bounded size; for
    daily bars that is a run of days, for bars with a time of day a single day. Two bars
    with the same (key, time) are an error. ``counts`` gives the number of bars (``_bars``) by key
    and ``_span`` where it is known without making them.
    """
    if span is None:
        daily = bars.schema[time].dataType.typeName() == "date"
        span = F.floor(F.unix_date(F.col(time).cast("date")) / (SPAN_DAYS if daily else 1))
    cut = bars.withColumn("_span", span)
    if counts is None:
        counts = cut.groupBy(key, "_span").agg(F.count(F.lit(1)).alias("_bars"))
    along = Window.partitionBy(key).orderBy("_span")
    starts = counts.select(
        key, "_span", (F.sum("_bars").over(along) - F.col("_bars")).alias("_before")
    )
    inside = Window.partitionBy(key, "_span").orderBy(time)
    # Numbered before the join, which keeps the order: the bars are sorted once.
    numbered = cut.withColumns(
        {"_row": F.row_number().over(inside), "_rank": F.dense_rank().over(inside)}
    ).join(starts, [key, "_span"])
    position = F.when(
        F.col("_row") == F.col("_rank"), F.col("_before") + F.col("_row")
    ).otherwise(F.raise_error(F.lit(f"bars must be unique by ({key}, {time})")))
    return numbered.withColumn(POSITION, position.cast("bigint")).drop(
        "_span", "_before", "_row", "_rank"
    )


def spread(
    indexed: DataFrame, back: int = 0, ahead: int = 0, block: int = BLOCK_ROWS, key: str = "ticker"
) -> DataFrame:
    """Put each bar into its own block and into every block that looks at it, with the rows of a block together.

    Where a bar stands in the block is worked out after the exchange, which then has less to carry.
    """
    place = F.col(POSITION) - 1
    own = idiv(place, block)
    first = idiv(F.greatest(place - ahead, F.lit(0)), block)
    last = idiv(place + back, block)
    blocks = F.when(first == last, F.array(own)).otherwise(F.sequence(first, last))
    return indexed.withColumn(_BLOCK, F.explode(blocks)).repartition(*block_keys(key)).withColumns(
        {
            _CORE: idiv(F.col(POSITION) - 1, block) == F.col(_BLOCK),
            _OFFSET: F.col(POSITION) - 1 - F.col(_BLOCK) * block,
        }
    )


def block_keys(key: str = "ticker") -> tuple[str, str]:
    """What the rows of one block have in common."""
    return key, _BLOCK


def block_window(key: str = "ticker") -> WindowSpec:
    """The one window all rolling columns are built on."""
    return Window.partitionBy(*block_keys(key)).orderBy(POSITION)


def settle(spread_rows: DataFrame, blocks: bool = False) -> DataFrame:
    """Keep each bar once, in its own block, and drop the layout columns; with ``blocks``, the block's number stays."""
    return spread_rows.where(F.col(_CORE)).drop(*[c for c in LAYOUT if not (blocks and c == _BLOCK)])


_LEAD = [0]


@contextmanager
def leading(rows: int) -> Iterator[None]:
    """Columns made inside are used from so many rows before a block's own rows on."""
    _LEAD.append(rows)
    try:
        yield
    finally:
        _LEAD.pop()


def offset() -> Column:
    """Row number inside the block, 0 for the first row whose result is used; earlier copies are below 0."""
    return F.col(_OFFSET) + _LEAD[-1]


def since(back: int) -> Column:
    """Whether a row is one of a block's own rows or of so many before them (or comes after them)."""
    return F.col(_OFFSET) >= -back


def rows(window: WindowSpec, count: int) -> WindowSpec:
    """The frame of the last ``count`` bars, the current one included."""
    return window.rowsBetween(-(count - 1), 0)
