"""Results that depend on everything before a row, without whole series in one task.

Each works in blocks: sum up the blocks side by side, carry the few block results
along, and finish every block with what was carried into it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.numeric import idiv
from tickloom.plans.layout import BLOCK_ROWS, POSITION, block_keys
from tickloom.sources.store import kept

RANK_BUCKETS = 256


# ---- running aggregates --------------------------------------------------------------


@dataclass(frozen=True)
class Fold:
    """An aggregate that skips NULL, and how two of its results combine."""

    how: Callable[[Column], Column]
    merge: Callable[[Column, Column], Column]


def _skip_null(both: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
    return lambda a, b: F.coalesce(both(a, b), a, b)


SUM = Fold(F.sum, _skip_null(lambda a, b: a + b))
PRODUCT = Fold(F.product, _skip_null(lambda a, b: a * b))
MAX = Fold(F.max, F.greatest)
MIN = Fold(F.min, F.least)


def running(
    series: DataFrame, value: Column, out: str, fold: Fold, key: str = "ticker",
    position: str = POSITION, block: int = BLOCK_ROWS, levels: int = 2,
) -> DataFrame:
    """Add the fold of ``value`` from the start of the series up to the current row.

    ``position`` must number the rows of a key 1, 2, ... Every level divides the rows
    that one task sees of a key by the block size.
    """
    upto = Window.unboundedPreceding
    if levels == 0:
        whole = Window.partitionBy(key).orderBy(position).rowsBetween(upto, 0)
        return series.withColumn(out, fold.how(value).over(whole))
    own, here, before = f"_block{levels}", f"_inside{levels}", f"_carry{levels}"
    cut = series.withColumn(own, idiv(F.col(position) - 1, block))
    following = f"_next{levels}"
    totals = cut.groupBy(key, own).agg(fold.how(value).alias("_total"))
    totals = totals.select(key, (F.col(own) + 1).alias(following), "_total")
    carried = running(
        totals, F.col("_total"), before, fold, key, following, block, levels - 1
    ).select(key, F.col(following).alias(own), before)
    inside = Window.partitionBy(key, own).orderBy(position).rowsBetween(upto, 0)
    return (
        cut.withColumn(here, fold.how(value).over(inside))
        .join(carried, [key, own], "left")
        .withColumn(out, fold.merge(F.col(before), F.col(here)))
        .drop(own, here, before)
    )


# ---- ranks ---------------------------------------------------------------------------


def dense_rank_by(
    df: DataFrame, keys: Sequence[str], value: str, out: str, descending: bool = True,
    buckets: int = RANK_BUCKETS,
) -> DataFrame:
    """Dense rank of ``value`` within ``keys`` (or over everything), NULL for NULL.

    Only distinct values are ranked; they are written down first, since they are read three times. They are cut at approximate quantiles into buckets
    that keep the order, so that a key's values are numbered by many tasks; the ranks are
    exact wherever the cuts fall.
    """
    keys = list(keys)
    distinct = kept(df.where(F.col(value).isNotNull()).select(*keys, value).distinct(), "distinct")
    cuts = [i / buckets for i in range(1, buckets)]
    splits = distinct.groupBy(*keys).agg(
        F.array_distinct(F.percentile_approx(value, cuts, 1000)).alias("_splits")
    )
    if keys:
        placed = distinct.join(splits, keys)
    else:
        placed = distinct.withColumn("_splits", splits.scalar())
    placed = placed.select(
        *keys, value, F.size(F.filter("_splits", lambda s: s <= F.col(value))).alias("_bucket")
    )
    order = F.desc if descending else F.asc
    along = Window.partitionBy(*keys).orderBy(order("_bucket"))
    starts = (
        placed.groupBy(*keys, "_bucket")
        .agg(F.count(F.lit(1)).alias("_size"))
        .withColumn("_before", F.sum("_size").over(along) - F.col("_size"))
        .drop("_size")
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(order(value))
    ranked = placed.join(starts, [*keys, "_bucket"]).select(
        *keys, value, (F.col("_before") + F.row_number().over(inside)).alias(out)
    )
    return df.join(ranked, [*keys, value], "left")


def number_rows(df: DataFrame, order: Column, bucket: Column, out: str) -> DataFrame:
    """Number all rows 1, 2, ... by (bucket, order) without one task seeing them all.

    ``bucket`` spreads the rows over a fixed number of groups of similar size.
    """
    cut = df.withColumns({"_bucket": bucket, "_order": order})
    along = Window.partitionBy(F.lit(0)).orderBy("_bucket")
    starts = (
        cut.groupBy("_bucket")
        .agg(F.count(F.lit(1)).alias("_size"))
        .withColumn("_before", F.sum("_size").over(along) - F.col("_size"))
        .drop("_size")
    )
    inside = Window.partitionBy("_bucket").orderBy("_order")
    return (
        cut.join(starts, "_bucket")
        .withColumn(out, F.col("_before") + F.row_number().over(inside))
        .drop("_bucket", "_order", "_before")
    )


# ---- state that only a loop can follow -----------------------------------------------


Columns = dict[str, list]


@dataclass(frozen=True)
class Machine:
    """A loop over the rows of a series whose state is passed from block to block.

    ``summarise`` describes a block as a function of the state it is entered with,
    ``compose`` chains two such descriptions, ``enter`` applies one to a state, and
    ``run`` gives the output columns of a block for a known state. Blocks come as
    columns in time order, ``inputs`` and the position among them.
    """

    start: dict
    inputs: Sequence[str]
    state_schema: str
    summary_schema: str
    output_schema: str
    summarise: Callable[[Columns], dict]
    compose: Callable[[dict, dict], dict]
    enter: Callable[[dict, dict], dict]
    run: Callable[[Columns, dict], Columns]


def _names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def _blocks(batches: Iterator[pd.DataFrame], key: str) -> Iterator[Columns]:
    """The blocks in a sorted partition, each put together from the batches it spans."""
    held: Columns | None = None
    for batch in batches:
        if not len(batch):
            continue
        keys, blocks = batch[key].to_numpy(), batch["_b"].to_numpy()
        turns = np.flatnonzero((keys[1:] != keys[:-1]) | (blocks[1:] != blocks[:-1])) + 1
        columns = {name: batch[name].tolist() for name in batch.columns}
        edges = [0, *turns.tolist(), len(batch)]
        for low, high in zip(edges, edges[1:]):
            part = {name: values[low:high] for name, values in columns.items()}
            if held and held[key][0] == part[key][0] and held["_b"][0] == part["_b"][0]:
                for name, values in part.items():
                    held[name] += values
                continue
            if held:
                yield held
            held = part
    if held:
        yield held


def _framed(found: Iterator[Columns], rows_at_once: int = 10000) -> Iterator[pd.DataFrame]:
    """Output columns of many blocks, put into frames of a fair size."""
    out: Columns = {}
    for columns in found:
        for name, values in columns.items():
            out.setdefault(name, []).extend(values)
        if len(next(iter(out.values()))) >= rows_at_once:
            yield pd.DataFrame(out)
            out = {}
    if out:
        yield pd.DataFrame(out)


def follow(
    rows: DataFrame, machine: Machine, key: str = "ticker", position: str = POSITION,
    block: int = BLOCK_ROWS, group: int = 1024, placed: bool = False,
) -> DataFrame:
    """Run a machine over every series, block by block in parallel.

    Blocks are summarised, then chained in groups, and the groups along the series; a
    task holds one block, one group of summaries, or the group summaries of one key.
    The last block of a series needs no summary.

    ``placed`` rows lie in blocks of this size already, in order (``compute(blocks=True)``), with all
    positions of a series from its first row on. Both passes then read that one exchange.
    """
    key_type = rows.schema[key].dataType.simpleString()
    names = list(dict.fromkeys([key, position, *machine.inputs]))
    start, enter, compose = machine.start, machine.enter, machine.compose
    described = _names(machine.summary_schema)
    if placed:
        cut = inner = rows.select(*names, F.col(block_keys(key)[1]).alias("_b"))
    else:
        cut = rows.select(*names).withColumn("_b", idiv(F.col(position) - 1, block))
        ends = cut.groupBy(key).agg(F.max("_b").alias("_end"))
        inner = cut.join(ends, key).where(F.col("_b") < F.col("_end")).drop("_end")

    def laid_out(df: DataFrame) -> DataFrame:
        # A join with the states streams the rows, so placed ones stay as they are.
        return df if placed else df.repartition(key, "_b").sortWithinPartitions(key, "_b", position)

    def goes_on(columns: Columns) -> bool:
        """Whether a block may be followed by another; where all positions are there, it is full then."""
        first, last, own = columns[position][0], columns[position][-1], columns["_b"][0]
        if not own * block < first <= last <= (own + 1) * block or last - first + 1 != len(columns[position]):
            raise ValueError(f"block {own} does not hold its positions in order")
        return last == (own + 1) * block

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def found() -> Iterator[Columns]:
            for columns in _blocks(batches, key):
                if placed and not goes_on(columns):
                    continue
                one = {key: columns[key][0], "_b": columns["_b"][0], **machine.summarise(columns)}
                yield {name: [value] for name, value in one.items()}

        return _framed(found())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def found() -> Iterator[Columns]:
            for columns in _blocks(batches, key):
                state = {n: v if columns["_entered"][0] else start[n] for n, v in
                         ((n, columns[f"_in_{n}"][0]) for n in start)}
                yield machine.run(columns, state)

        return _framed(found())

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = pdf.sort_values("_b").to_dict("records")
        whole = reduce(compose, parts)
        here = {key: parts[0][key], "_g": parts[0]["_g"]}
        return pd.DataFrame([{**here, **{name: whole[name] for name in described}}])

    def entries(pdf: pd.DataFrame, order: str, state: dict) -> pd.DataFrame:
        found = []
        for part in pdf.sort_values(order).to_dict("records"):
            state = enter(part, state)
            found.append({key: part[key], order: part[order] + 1, **state})
        return pd.DataFrame(found)

    def entries_of_groups(pdf: pd.DataFrame) -> pd.DataFrame:
        return entries(pdf, "_g", start)

    def entries_of_blocks(pdf: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame(columns=[key, "_b", *start])
        state = given.to_dict("records")[0] if len(given) else start
        return entries(pdf, "_b", {name: state[name] for name in start})

    summaries = laid_out(inner).mapInPandas(
        summarise, f"{key} {key_type}, _b bigint, {machine.summary_schema}"
    ).withColumn("_g", idiv(F.col("_b"), group))
    chained = summaries.groupBy(key, "_g").applyInPandas(
        chain, f"{key} {key_type}, _g bigint, {machine.summary_schema}"
    )
    into_groups = chained.groupBy(key).applyInPandas(
        entries_of_groups, f"{key} {key_type}, _g bigint, {machine.state_schema}"
    )
    into_blocks = (
        summaries.groupBy(key, "_g")
        .cogroup(into_groups.groupBy(key, "_g"))
        .applyInPandas(entries_of_blocks, f"{key} {key_type}, _b bigint, {machine.state_schema}")
    )
    states = into_blocks.select(
        key, "_b", F.lit(True).alias("_entered"), *[F.col(n).alias(f"_in_{n}") for n in start]
    )
    entered = cut.join(states, [key, "_b"], "left").withColumn(
        "_entered", F.coalesce("_entered", F.lit(False))
    )
    return laid_out(entered).mapInPandas(run, machine.output_schema)
