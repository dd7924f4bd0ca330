"""Column layers with declared inputs and look-back, put together into one job."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.arrays import list_quantile
from tickloom.functions.order import SlidingOrder
from tickloom.plans.layout import BLOCK_ROWS, LAYOUT, POSITION, block_keys, block_window, leading, rows, settle, since, spread

Layers = Sequence[Mapping[str, Column]]

#: Own bars a block should have at least.
MIN_BLOCK = 256
#: Frames up to this length are sorted as lists, row by row: less work than handing a block to Python.
SHORT_FRAME = 130


@dataclass(frozen=True, eq=False)
class Quantile:
    """Column ``out``: a quantile of ``value`` over the last ``bars`` bars; NULL takes no part, NaN is largest."""

    out: str
    value: Column
    bars: int
    fraction: float = 0.5
    kind: str = "linear"


@dataclass(frozen=True)
class Step:
    """Columns added to a bar table.

    ``layers(window)`` gives groups of columns; a group may read the columns of the
    groups and steps before it. ``back`` and ``ahead`` say how many bars before and
    after the current one the step reads. ``quantiles`` are found before the layers, which may read them. ``span`` bounds the rows from the first whose result is
    used, which may be a copy that a dependent step looks at, to the last copy after a block.
    """

    name: str
    layers: Callable[[WindowSpec], Layers] = field(compare=False)
    needs: tuple["Step", ...] = ()
    back: int = 0
    ahead: int = 0
    span: int | None = None
    quantiles: tuple[Quantile, ...] = field(default=(), compare=False)

    def long_quantiles(self) -> list[Quantile]:
        return [q for q in self.quantiles if q.bars > SHORT_FRAME]

    def all_layers(self, window: WindowSpec) -> Iterator[dict[str, Column]]:
        """The layers, those of short quantiles first."""
        short = [q for q in self.quantiles if q.bars <= SHORT_FRAME]
        if short:
            frames = {(str(q.value), q.bars): q for q in short}
            names = {key: f"_{self.name}_{i}" for i, key in enumerate(frames)}
            yield {
                names[key]: F.sort_array(F.collect_list(q.value).over(rows(window, q.bars)))
                for key, q in frames.items()
            }
            yield {q.out: list_quantile(F.col(f"`{names[str(q.value), q.bars]}`"), q.fraction, q.kind) for q in short}
        yield from (dict(layer) for layer in self.layers(window))

    def reach_back(self) -> int:
        return self.back + max((s.reach_back() for s in self.needs), default=0)

    def reach_ahead(self) -> int:
        return self.ahead + max((s.reach_ahead() for s in self.needs), default=0)


def in_order(steps: Iterable[Step]) -> list[Step]:
    """Every needed step once, inputs first."""
    found: dict[str, Step] = {}

    def visit(step: Step) -> None:
        if step.name in found:
            return
        for need in step.needs:
            visit(need)
        found[step.name] = step

    for step in steps:
        visit(step)
    return list(found.values())


def leads_of(steps: Sequence[Step]) -> dict[str, int]:
    """How many bars before a block's own ones the result of each step is looked at."""
    leads = {step.name: 0 for step in steps}
    for step in reversed(steps):  # dependents first
        for need in step.needs:
            if need.name in leads:
                leads[need.name] = max(leads[need.name], leads[step.name] + step.back)
    return leads


def waves(steps: Sequence[Step], leads: Mapping[str, int]) -> list[tuple[int, list[Step]]]:
    """The steps that look far back before the first wanted bar, then the others, each with the farthest of these looks.

    A step looks at least as far back as what depends on it. Two waves only, since each adds passes over the rows.
    """
    needs = {step.name: leads[step.name] + step.back for step in steps}
    far = max(needs.values(), default=0) / 3
    parts = [s for s in steps if needs[s.name] > far], [s for s in steps if needs[s.name] <= far]
    return [(max(needs[s.name] for s in part), part) for part in parts if part]


def rounds(steps: Sequence[Step]) -> Iterator[tuple[list[Quantile], list[Step]]]:
    """The steps in as few rounds as there are passes for quantiles, each with the quantiles it starts with."""
    left, here = list(steps), {step.name for step in steps}
    done: set[str] = set()
    started = False
    while left:
        now: list[Step] = []
        ready: set[str] = set()
        for step in left:  # inputs come first
            waits = {n.name for n in step.needs if n.name in here} - done
            if waits <= ready and not (step.long_quantiles() and (waits or not started)):
                now.append(step)
                ready.add(step.name)
        if now:
            yield [q for step in now for q in step.long_quantiles()], now
        left = [step for step in left if step.name not in ready]
        done |= ready
        started = True


def with_quantiles(spread_rows: DataFrame, wanted: Sequence[Quantile]) -> DataFrame:
    """Add sliding quantiles to rows in blocks, all of them in one pass over each block.

    The blocks lie together already, so there is no further exchange; a group is one block with its copies.
    Work columns of earlier steps, which no other step reads, are left behind.
    """
    groups: dict[str, list[Quantile]] = {}
    sources: dict[str, Column] = {}
    for q in wanted:
        text = str(q.value)
        groups.setdefault(text, []).append(q)
        sources.setdefault(text, q.value.cast("double"))
    names = {text: f"_value_{i}" for i, text in enumerate(groups)}
    with_values = spread_rows.withColumns({names[text]: value for text, value in sources.items()})
    plan = [(names[text], [(q.out, q.bars, q.fraction, q.kind) for q in qs]) for text, qs in groups.items()]
    kept = [c for c in spread_rows.columns if c in LAYOUT or not c.startswith("_")]
    schema = T.StructType(
        [*spread_rows.select(*kept).schema.fields, *[T.StructField(out, T.DoubleType()) for _, qs in plan for out, *_ in qs]]
    )

    def of_block(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        place = table.column(POSITION).to_numpy()
        if len(place) > 1 and not (place[1:] > place[:-1]).all():
            table = table.take(pa.array(np.argsort(place, kind="stable")))
        made = table.select(kept)
        for name, qs in plan:
            column = table.column(name)
            absent = column.is_null().to_numpy().astype(bool)
            values = column.fill_null(0.0).to_numpy()
            found = SlidingOrder(values, absent).quantiles([tuple(q[1:]) for q in qs])
            for (out, *_), (result, empty) in zip(qs, found, strict=True):
                made = made.append_column(out, pa.array(result, pa.float64(), mask=empty))
        return made

    return with_values.select(*kept, *names.values()).groupBy(*block_keys()).applyInArrow(of_block, schema)


def side_by_side(
    steps: Sequence[Step], window: WindowSpec, leads: Mapping[str, int] | None = None
) -> Iterator[dict[str, Column]]:
    """The layers of all steps, those that do not wait for each other put into one.

    Window columns of one layer are evaluated in a single pass over the rows.
    """
    waiting: dict[str, tuple[Step, list[dict[str, Column]]]] = {}
    leads = leads_of(steps) if leads is None else leads
    for step in steps:
        with leading(leads[step.name]):
            waiting[step.name] = (step, list(step.all_layers(window)))
    here = set(waiting)
    done: set[str] = set()
    while waiting:
        ready = [n for n, (step, _) in waiting.items() if all(s.name in done or s.name not in here for s in step.needs)]
        together: dict[str, Column] = {}
        for name in ready:
            layers = waiting[name][1]
            if layers:
                together.update(layers.pop(0))
            if not layers:
                del waiting[name]
                done.add(name)
        if together:
            yield together


def compute(
    indexed: DataFrame, *steps: Step, select: Sequence[str | Column] | None = None,
    block: int | None = None, given: frozenset[str] = frozenset(), blocks: bool = False,
    due: str | None = None,
) -> DataFrame:
    """Add the columns of ``steps`` to indexed bars, with one exchange for all of them.

    A block has twice as many bars as it needs copies, so that these stay below half of the rows, unless
    the weights of a steep average end it sooner. No result depends on the size of the blocks. An average too
    steep for what looks back at it is computed in a pass of its own. The columns of the steps named in
    ``given`` are there already. With ``blocks``, the number of the block stays as a column, for what goes on with the
    rows where they lie, by block and in order; blocks then have exactly ``block`` bars.

    ``due`` names a column with the first bar_index of an instrument whose result counts. The steps that look farthest back then
    come first, and rows are left behind as soon as no step that is left looks at them; earlier results are not to be used.
    """
    if blocks and not steps:
        raise ValueError("rows are put in order for the windows of a step")
    todo = [s for s in in_order(steps) if s.name not in given]
    leads = leads_of(todo)
    back = max((s.reach_back() for s in todo), default=0)
    ahead = max((s.reach_ahead() for s in todo), default=0)
    for step in todo:
        if step.span and step.span - ahead - leads[step.name] < MIN_BLOCK and leads[step.name]:
            first = compute(indexed, step, block=block, given=given)
            names = {s.name for s in in_order([step])}
            return compute(first, *steps, select=select, block=block, given=given | names, blocks=blocks)
    spans = [max(1, s.span - ahead - leads[s.name]) for s in todo if s.span]
    wanted = block
    block = min([block or max(BLOCK_ROWS, 2 * (back + ahead)), *spans])
    if blocks and block != wanted:
        raise ValueError(f"these steps need blocks of at most {block} bars")
    out = spread(indexed, back, ahead, block)
    window = block_window()
    for need, some in waves(todo, leads) if due else [(back, todo)]:
        if due:
            out = out.where(since(need) & (F.col(POSITION) >= F.col(due) - need))
        for quantiles, now in rounds(some):
            if quantiles:
                out = with_quantiles(out, quantiles)
            for layer in side_by_side(now, window, leads):
                out = out.withColumns(layer)
    out = settle(out, blocks)
    if select is not None:
        return out.select(*select)
    # Columns of work steps go, so that no exchange or window carries them along.
    return out.drop(*[c for c in out.columns if c.startswith("_") and not (blocks and c in block_keys())])


def identity(columns: Iterable[str], function: str, params: Mapping[str, object]) -> str:
    """The uid of an indicator: source columns (sorted), function and parameters."""
    text = json.dumps([sorted(columns), function, dict(params)], sort_keys=True, default=str)
    return hashlib.sha256(text.encode()).hexdigest()[:12]
