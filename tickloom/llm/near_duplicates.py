"""Near-duplicate groups by bottom-k sketches (operator 1).

A document's set holds the hashes of its distinct word shingles. Documents with equal sets form
a class, and one of them stands for it from then on. A class is sketched with one hash function
only: its smallest hashes.

1. *Inverted lists.* The ``RETAINED`` smallest hashes are the values a class is listed under. Two
   sets with a similarity of 0.8 share at least ``SHARED`` of them (the chance of fewer is below
   1e-6; sets that fit into the sketch are held to the exact number). So a class needs to be listed
   only under its rarest values, as many as leave room for fewer than ``SHARED`` others. Values that
   occur once generate nothing, so documents that merely have a passage in common with others are
   listed nowhere.
2. *Estimate.* Pairs from one list are compared by the union of their ``SKETCH`` smallest hashes.
   What lies five standard deviations below the wanted similarity is left out; for sets that fit
   into the sketch the estimate is exact.
3. *Verification.* The full sets of the remaining pairs are built from the texts and compared.

Lists of common values are long, and pairs within them would grow with the square. The first round
cuts them into parts and verifies only the best partner of each class; the links found make
components. The second round looks at all pairs of a list that still lie in different
components, long lists in blocks against blocks. Thus every link that could join two components
is verified, while pairs within a component need not be. Where the estimate is exact, a link found
joins the two components for the rest of the list, so that links do not pile up in dense groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.components import components
from tickloom.llm.shared import stored, text_key, workspace
from tickloom.llm.words import BLANK, grams, slices, split

RETAINED = 32
SHARED = 14
SKETCH = 256
#: Classes of a list that are compared with each other in one part of the first round.
PART = 128
#: Classes of a list in one block of the second round.
BLOCK = 1024
#: Pairs compared at a time within a task.
PAIRS = 1 << 12

_PRINTS = "doc_id bigint, high bigint, low bigint, n int, node bigint, retained array<bigint>, sketch binary"


def _printer(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield _prints(part, size)

    return run


def _prints(part: pa.RecordBatch, size: int) -> pa.RecordBatch:
    hashes, edges = grams(split(part.column("text"), BLANK, fold=True), size)
    # sort all sets at once: by text, then by hash
    text = np.repeat(np.arange(part.num_rows), np.diff(edges))
    order = np.lexsort((hashes, text))
    hashes = hashes[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    hashes, text = hashes[fresh], text[fresh]
    count = np.bincount(text, minlength=part.num_rows)
    first = np.concatenate([[0], np.cumsum(count)])
    running = np.concatenate([[np.uint64(0)], np.cumsum(hashes * np.uint64(0x9FB21C651E98DF25) ^ hashes >> np.uint64(7))])
    node = (running[first[1:]] - running[first[:-1]]) ^ count.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    rank = np.arange(len(hashes)) - first[text]
    kept = hashes[rank < RETAINED].view(np.int64)
    kept_edges = np.concatenate([[0], np.cumsum(np.minimum(count, RETAINED))])
    short = (hashes[rank < SKETCH] >> np.uint64(32)).astype("<u4")
    short_edges = np.concatenate([[0], np.cumsum(np.minimum(count, SKETCH))]) * 4
    empty = count == 0
    return pa.record_batch(
        [
            part.column("doc_id").cast(pa.int64()),
            part.column("high"),
            part.column("low"),
            pa.array(count.astype(np.int32)),
            pa.array(node.view(np.int64), mask=empty),
            pa.ListArray.from_arrays(pa.array(kept_edges, pa.int32()), pa.array(kept)),
            pa.Array.from_buffers(
                pa.binary(),
                part.num_rows,
                [None, pa.py_buffer(short_edges.astype(np.int32)), pa.py_buffer(short.tobytes())],
            ),
        ],
        names=["doc_id", "high", "low", "n", "node", "retained", "sketch"],
    )


def _listed(classes: DataFrame) -> DataFrame:
    """(value, df, node, n, prefix): the values each class is listed under."""
    entries = classes.select("node", "n", F.explode("retained").alias("value"))
    common = entries.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    entries = stored(entries.join(common, "value"), "entries")
    lists = entries.groupBy("node").agg(
        F.first("n").alias("n"),
        F.array_sort(F.collect_list(F.struct("df", "value"))).alias("values"),  # at most RETAINED
    )
    size = F.least("n", F.lit(RETAINED))
    needed = F.when(F.col("n") * 1.25 <= RETAINED, F.ceil(F.col("n") * 0.8)).otherwise(SHARED)
    room = size - needed + 1 - (size - F.size("values"))
    lists = lists.where(room > 0).select("node", "n", F.slice("values", 1, room.cast("int")).alias("values"))
    prefix = F.array_sort(F.col("values.value")).alias("prefix")
    return lists.select("node", "n", prefix, F.explode("values").alias("v")).select(
        "node", "n", "prefix", "v.value", "v.df"
    )


def _lowest(total: np.ndarray, similarity: float) -> np.ndarray:
    """The fewest common values in the union sketch of two sets with ``total`` members together."""
    union = total / (1 + similarity)
    left = np.clip((union - SKETCH) / np.maximum(union - 1, 1), 0, 1)
    return SKETCH * similarity - 5 * np.sqrt(SKETCH * similarity * (1 - similarity) * left)


def _estimates(sketch: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray, similarity: float):
    """Common share of the union sketch of the pairs, whether it is high enough, and if it is exact."""
    share, good, exact = np.zeros(len(a)), np.zeros(len(a), bool), np.zeros(len(a), bool)
    for s in range(0, len(a), PAIRS):
        x, y = a[s : s + PAIRS], b[s : s + PAIRS]
        both = np.concatenate([sketch[x], sketch[y]], axis=1)
        both.sort(axis=1)
        real = both < np.iinfo(np.int64).max
        again = np.zeros(both.shape, bool)
        again[:, 1:] = (both[:, 1:] == both[:, :-1]) & real[:, 1:]
        place = np.cumsum(~again & real, axis=1)
        size = np.minimum(place[:, -1], SKETCH)
        common = (again & (place <= SKETCH)).sum(axis=1)
        share[s : s + PAIRS] = common / np.maximum(size, 1)
        whole = (n[x] <= SKETCH) & (n[y] <= SKETCH) & (place[:, -1] <= SKETCH)
        bound = np.where(whole, similarity * size - 1e-6, np.minimum(_lowest(n[x] + n[y], similarity), similarity * size))
        good[s : s + PAIRS] = common >= bound
        exact[s : s + PAIRS] = whole
    return share, good, exact


class _Members:
    """The classes of one or more lists, as arrays."""

    def __init__(self, table: pa.Table) -> None:
        self.node = table["node"].to_numpy()
        self.n = table["n"].to_numpy().astype(np.int64)
        self.value = table["value"].to_numpy()
        self.unit = table["unit"].to_numpy()
        self.label = table["label"].to_numpy().copy()
        self.side = table["side"].to_numpy()
        self.sketch = _padded(table["sketch"].combine_chunks(), SKETCH)
        prefix = table["prefix"].combine_chunks()
        count = prefix.value_lengths().to_numpy()
        self.prefix = np.full((len(count), max(1, int(count.max(initial=1)))), np.iinfo(np.int64).max)
        row = np.repeat(np.arange(len(count)), count)
        at = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        self.prefix[row, at] = prefix.flatten().to_numpy()

    def first_in_common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether this list is the first that the two classes of a pair share."""
        out = np.zeros(len(a), bool)
        for s in range(0, len(a), PAIRS):
            x, y = a[s : s + PAIRS], b[s : s + PAIRS]
            both = np.concatenate([self.prefix[x], self.prefix[y]], axis=1)
            both.sort(axis=1)
            same = both[:, 1:] == both[:, :-1]
            out[s : s + PAIRS] = both[np.arange(len(x)), np.argmax(same, axis=1)] == self.value[x]
        return out


    def joining(self, a: np.ndarray, b: np.ndarray, exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of exact links those that join two components, which are one from then on; all others."""
        first, second = [a[~exact]], [b[~exact]]
        a, b = a[exact], b[exact]
        while len(a):
            first.append(a[:1])
            second.append(b[:1])
            unit = (self.value == self.value[a[0]]) & (self.unit == self.unit[a[0]])
            self.label[unit & (self.label == self.label[b[0]])] = self.label[a[0]]
            apart = self.label[a] != self.label[b]
            a, b = a[apart], b[apart]
        return np.concatenate(first), np.concatenate(second)


def _padded(sketches: pa.Array, width: int) -> np.ndarray:
    _, offsets, data = sketches.buffers()
    edges = np.frombuffer(offsets, np.int32)[sketches.offset : sketches.offset + len(sketches) + 1] // 4
    flat = np.frombuffer(data, "<u4") if data is not None else np.zeros(0, "<u4")
    count = np.diff(edges)
    out = np.full((len(count), width), np.iinfo(np.int64).max)
    row = np.repeat(np.arange(len(count)), count)
    out[row, np.arange(len(row)) - np.repeat(edges[:-1] - edges[0], count)] = flat[edges[0] : edges[-1]]
    return out


def _units(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """Whole units out of sorted batches, several at a time; a unit is never cut."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(k).to_numpy(zero_copy_only=False) for k in key]
        change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        if rest and any(rest[-1].column(k)[-1].as_py() != batch.column(k)[0].as_py() for k in key):
            change = np.concatenate([[0], change])
        if len(change):
            rest.append(batch.slice(0, change[-1]))
            yield pa.Table.from_batches(rest)
            rest = []
        rest.append(batch.slice(change[-1]) if len(change) else batch)
    if rest:
        yield pa.Table.from_batches(rest)


def _pairs_within(m: _Members, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a unit whose lengths allow a link and that are not in one component yet.

    In a unit of two blocks, members of different blocks are paired.
    """
    edge = np.flatnonzero(
        np.concatenate([[True], (m.value[1:] != m.value[:-1]) | (m.unit[1:] != m.unit[:-1])])
    )
    last = np.append(edge[1:], len(m.value))
    stop = np.repeat(last, last - edge)
    ahead = stop - np.arange(len(stop)) - 1
    total = np.concatenate([[0], np.cumsum(ahead)])
    at = 0
    while at < len(stop):
        to = max(at + 1, int(np.searchsorted(total, total[at] + 64 * PAIRS, "right")) - 1)
        a = np.repeat(np.arange(at, to), ahead[at:to])
        b = a + 1 + np.arange(len(a)) - np.repeat(total[at:to] - total[at], ahead[at:to])
        low, high = np.minimum(m.n[a], m.n[b]), np.maximum(m.n[a], m.n[b])
        good = (100 * low >= percent * high) & (m.label[a] != m.label[b])
        good &= (m.side[a] < 0) | (m.side[a] != m.side[b])
        a, b = a[good], b[good]
        good = m.first_in_common(a, b)
        yield a[good], b[good]
        at = to


def _candidates(best: bool, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _units(batches, ["value", "unit"]):
            m = _Members(table)
            top, partner = np.zeros(len(m.node)), np.full(len(m.node), -1)
            for a, b in _pairs_within(m, percent):
                share, good, exact = _estimates(m.sketch, m.n, a, b, percent / 100)
                a, b, share, exact = a[good], b[good], share[good], exact[good]
                if best:  # the best partner in the list for each class but the first
                    order = np.lexsort((share, b))
                    a, b, share = a[order], b[order], share[order]
                    end = np.append(b[1:] != b[:-1], True) if len(b) else np.zeros(0, bool)
                    a, b, share = a[end], b[end], share[end]
                    better = share > top[b]
                    top[b[better]], partner[b[better]] = share[better], a[better]
                else:
                    yield _pairs(m, *m.joining(a, b, exact))
            if best and (partner >= 0).any():
                b = np.flatnonzero(partner >= 0)
                yield _pairs(m, partner[b], b)

    return run


def _pairs(m: _Members, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    x, y = m.node[a], m.node[b]
    return pa.record_batch([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])


def _verify(size: int, percent: int):
    def shingles(texts: pa.Array) -> np.ndarray:
        return np.unique(grams(split(texts, BLANK, fold=True), size)[0])

    def linked(pair: pa.RecordBatch) -> bool:
        x, y = shingles(pair.column("text_a")), shingles(pair.column("text_b"))
        both = len(np.intersect1d(x, y, assume_unique=True))
        return both > 0 and 100 * both >= percent * (len(x) + len(y) - both)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [linked(batch.slice(i, 1)) for i in range(batch.num_rows)]
            yield batch.filter(pa.array(good, pa.bool_())).select(["a", "b"])

    return run


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Group documents whose sets of ``words``-word shingles have a similarity of ``percent`` / 100.

    ``docs`` needs doc_id and text, other columns are ignored. Returns for each row doc_id,
    high and low (a 128-bit key of the text), n_shingles, component_id (the smallest doc_id that
    links lead to, its own included), kept (doc_id = component_id), group (a number of the component).

    A text with fewer words is one shingle. A text that is null or has no words has an empty set
    and is linked with nothing, not even with another such text; its group is null. Rows with the same set belong
    together, whatever their doc_id; a row without doc_id is linked like any other but never
    names a component unless no member has a doc_id, and then component_id is null and kept false.
    Repeated rows appear as often as they come. An empty table gives an empty result.
    ``percent`` below 80 is refused, as the lists are laid out for 80 and would lose links.
    """
    if percent < 80:
        raise ValueError("the lists find all links from 80 percent on only")
    with workspace(docs.sparkSession):
        grouped = stored(_grouped(docs, words, percent), "grouped", keep=True)
    smallest = grouped.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("smallest"))
    component = F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("smallest"))
    return grouped.join(smallest, "label", "left").select(
        "doc_id",
        "high",
        "low",
        F.col("n").cast("bigint").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"),
        F.col("label").alias("group"),
    )


def _grouped(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, high, low, n, node and label (the same for all of a component) of each row."""
    given = docs.select(F.col("doc_id").cast("bigint"), "text").select(
        "doc_id", "text", text_key(F.col("text")).alias("k")
    )
    rows = given.select("doc_id", "k.high", "k.low", "text")
    prints = stored(rows.mapInArrow(_printer(words), _PRINTS), "prints")
    classes = (
        prints.where("n > 0")
        .groupBy("node")
        .agg(*(F.first(c).alias(c) for c in ("n", "high", "low", "retained", "sketch")))
    )
    classes = stored(classes, "classes")
    sketches = classes.select("node", "sketch")
    listed = stored(_listed(classes), "listed")

    wanted = listed.select("node").distinct().join(classes.select("node", "high", "low"), "node")
    texts = given.select("k.high", "k.low", "text").join(wanted, ["high", "low"]).groupBy("node").agg(
        F.first("text").alias("text")
    )
    texts = stored(texts, "texts")

    def verified(pairs: DataFrame) -> DataFrame:
        sides = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(
            texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b"
        )
        return sides.select("a", "b", "text_a", "text_b").mapInArrow(
            _verify(words, percent), "a bigint, b bigint"
        )

    def found(units: DataFrame, best: bool) -> DataFrame:
        full = units.join(sketches, "node").select(
            "value", "unit", "side", "node", "n", "label", "prefix", "sketch"
        )
        laid = full.repartition("value", "unit").sortWithinPartitions("value", "unit")
        return laid.mapInArrow(_candidates(best, percent), "a bigint, b bigint").distinct()

    parts = F.ceil(F.col("df") / PART)
    first = listed.withColumns(
        {
            "unit": F.pmod(F.xxhash64("node", "value"), parts).cast("int"),
            "side": F.lit(-1),
            "label": F.col("node"),
        }
    )
    links = verified(found(first, True))
    early = components(links)

    open_lists = (
        listed.join(early.withColumnRenamed("label", "known"), "node", "left")
        .withColumn("label", F.coalesce("known", "node"))
        .drop("known")
    )
    open_lists = stored(open_lists, "labelled")
    mixed = open_lists.groupBy("value").agg(
        F.min("label").alias("least"), F.max("label").alias("most"), F.count("*").alias("m")
    ).where("least <> most")
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    second = open_lists.join(mixed.select("value", "m"), "value").withColumns(
        {"blocks": blocks, "block": F.pmod(F.xxhash64("value", "node"), blocks).cast("int")}
    )
    # a member of block i takes part in the units (i, j) and (j, i) of two blocks
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    second = second.withColumn("other", other).withColumns(
        {
            "unit": F.least("block", "other") * F.col("blocks") + F.greatest("block", "other"),
            "side": F.when(F.col("block") == F.col("other"), -1).otherwise(F.col("block")),
        }
    )
    # members of one block meet in the unit (i, i); in a unit of two blocks only across
    late = verified(found(second, False))
    named = early.withColumnRenamed("label", "group")
    late = (
        late.join(named.withColumnRenamed("node", "a"), "a", "left")
        .withColumn("x", F.coalesce("group", "a"))
        .drop("group")
        .join(named.withColumnRenamed("node", "b"), "b", "left")
        .select(F.col("x").alias("a"), F.coalesce("group", "b").alias("b"))
    )
    merged = components(late)
    label = (
        early.join(merged.select(F.col("node").alias("label"), F.col("label").alias("final")), "label", "left")
        .select("node", F.coalesce("final", "label").alias("label"))
        .unionByName(merged.join(early, "node", "left_anti"))
    )
    return prints.drop("retained", "sketch").join(label, "node", "left").withColumn(
        "label", F.coalesce("label", "node")
    )
