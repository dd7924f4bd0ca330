"""A trie of conversations with hashed handles (operator 11).

A conversation is a sequence of turns, known by 128-bit hashes of its prefixes. The trie is compacted: a stretch without
branches is one node, which reaches from the depth ``p`` of its parent to its own depth ``e``. It is stored under its
handle, the prefix whose length is the number in (p, e] that the largest power of two divides. A conversation finds the
node in which it leaves the trie by a binary search over such lengths: each step is a join of all
conversations that still search with the handles, and halves what is left. The last join is by the first turn
of a node, and the hashes that the node holds tell at which turn the conversation leaves.

Conversations are inserted in batches, a few first, then many. Those of a batch that leave the trie at one place with the
same turn form a group; one of each group, chosen by a hash, becomes a new path below that place, the others follow it as
far as they can, and form new groups where they leave it. As the choice is random, groups shrink by halves and few
rounds are needed. After a batch, nodes are cut where paths branch off.

Numbers of nodes are summed along the paths, from those that hang deepest to the first. Then each node of a path is
expanded into one row per depth.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.shared import stored, workspace
from tickloom.llm.words import mix

_KEYS = "array<struct<high:bigint,low:bigint>>"
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
#: Shares of the conversations, in sixteenths, that are inserted together.
BATCHES = (1, 3, 12)
_EVENT = "path bigint, m int, n_convs bigint, first bigint, n_leaves bigint, saved bigint, kids bigint, digest string"
_EMPTY = hashlib.sha256(b"").hexdigest()


def sequences(turns: DataFrame) -> DataFrame:
    """(conv_id, turns) from rows of conv_id, turn, role and text; a turn is two hashes and the bytes of its text.

    Turns are in the order of ``turn``, null first; rows that agree in it are ordered by a hash of role and text. Null roles
    and texts are empty, rows without conv_id are left out. A conversation is one row of 32 bytes a turn.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turn = F.struct(
        "turn",
        F.xxhash64(role, text).alias("high"),
        F.xxhash64(F.lit("turn"), text, role).alias("low"),
        F.octet_length(text).cast("bigint").alias("size"),
    )
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv_id"), turn.alias("t"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return grouped.select("conv_id", F.transform("turns", lambda t: t.dropFields("turn")).alias("turns"))


def _hash_prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of all prefixes: sums of the turns' hashes times powers of an odd number, mixed with the length."""
    for batch in batches:
        lists = batch.column("turns")
        count = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        edges = np.append(0, np.cumsum(count))
        turns = lists.flatten()
        at = np.arange(edges[-1]) - np.repeat(edges[:-1], count)
        keys = []
        for name, base in zip(("high", "low"), _BASES):
            power = np.full(count.max(initial=0) + 1, base, np.uint64)
            power[0] = 1
            power = np.multiply.accumulate(power)
            part = mix(turns.field(name).to_numpy().view(np.uint64) + base) * power[at]
            sums = np.append(np.uint64(0), np.cumsum(part, dtype=np.uint64))
            own = sums[1:] - np.repeat(sums[edges[:-1]], count)
            keys.append(pa.array(mix(own + (at + 1).astype(np.uint64) * base).view(np.int64)))
        offsets = pa.array(edges.astype(np.int32))
        both = pa.StructArray.from_arrays(keys, ["high", "low"])
        yield pa.record_batch(
            [
                batch.column("conv_id"),
                pa.array(count.astype(np.int32)),
                pa.ListArray.from_arrays(offsets, both),
                pa.ListArray.from_arrays(offsets, turns.field("size")),
            ],
            names=["conv_id", "n", "keys", "sizes"],
        )


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of rows that agree in n, high and low as one row, their ids joined by commas."""
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c).to_numpy() for c in ("n", "high", "low")]
        new = np.append(True, np.any([c[1:] != c[:-1] for c in columns], axis=0))
        start = np.flatnonzero(new)
        ids = batch.column("conv_id").to_pylist()
        packed = [",".join(map(str, ids[s:e])) for s, e in zip(start, [*start[1:], len(ids)])]
        first = [ids[s] for s in start]
        yield pa.record_batch(
            [*(pa.array(c[start]) for c in columns), pa.array(first, pa.int64()), pa.array(packed)],
            names=["n", "high", "low", "first", "ids"],
        )


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the packed ids of each n, high and low; rows come sorted and are read one by one."""
    current, running = None, None

    def closed():
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.string()]
        values = [*current, running.hexdigest()]
        return pa.record_batch([pa.array([v], k) for v, k in zip(values, kinds)], names=["n", "high", "low", "digest"])

    for batch in batches:
        for *key, ids in zip(*(batch.column(c).to_pylist() for c in ("n", "high", "low", "ids"))):
            if key == current:
                running.update(b"," + ids.encode())
                continue
            if current is not None:
                yield closed()
            current, running = key, hashlib.sha256(ids.encode())
    if current is not None:
        yield closed()


def _classes(hashed: DataFrame) -> DataFrame:
    """Equal conversations as one row: the smallest id, how many there are, and the digest of all their ids."""
    last = F.expr("element_at(keys, nullif(n, 0))")
    rows = hashed.withColumns(
        {"high": F.coalesce(last["high"], F.lit(0)), "low": F.coalesce(last["low"], F.lit(0))}
    )
    same = ["n", "high", "low"]
    ids = rows.select(*same, "conv_id").repartitionByRange(*same, "conv_id").sortWithinPartitions(*same, "conv_id")
    packed = ids.mapInArrow(_pack, "n int, high bigint, low bigint, first bigint, ids string")
    packed = packed.repartition(*same).sortWithinPartitions(*same, "first")
    digests = packed.mapInArrow(_digest, "n int, high bigint, low bigint, digest string")
    one = rows.groupBy(*same).agg(
        F.min("conv_id").alias("id"),
        F.count(F.lit(1)).alias("members"),
        F.min_by(F.struct("keys", "sizes"), "conv_id").alias("one"),
    )
    return one.join(digests, same).select("id", "n", "members", "digest", "one.keys", "one.sizes")


def two_fattest(low: str, high: str) -> Column:
    """The number in (low, high] that the largest power of two divides."""
    bit = f"(length(bin({low} ^ {high})) - 1)"
    return F.expr(f"shiftleft(shiftright({high}, {bit}), {bit})")


def _cut(nodes: DataFrame, places: DataFrame) -> DataFrame:
    """Nodes cut at the given depths ``m`` of their paths."""
    cuts = places.groupBy(F.col("path").alias("of")).agg(F.collect_set("m").alias("cuts"))
    rows = nodes.join(cuts, F.col("path") == F.col("of"), "left")
    inside = F.expr("array_sort(filter(coalesce(cuts, array()), m -> m > p and m < e))")
    rows = rows.withColumn("ends", F.concat(inside, F.array("e"))).withColumn("starts", F.concat(F.array("p"), inside))
    rows = rows.select("path", "level", "p", "edge", F.explode(F.arrays_zip("starts", "ends")).alias("part"))
    edge = F.expr("slice(edge, part.starts - p + 1, part.ends - part.starts)")
    return rows.select("path", "level", F.col("part.starts").alias("p"), F.col("part.ends").alias("e"), edge.alias("edge"))


def _common(own: str, other: str) -> Column:
    """How many of the first hashes of two lists agree."""
    return F.expr(f"size(filter(zip_with({own}, {other}, (x, y) -> x = y), t -> t))")


def _locate(batch: DataFrame, nodes: DataFrame, steps: int) -> DataFrame:
    """Where each conversation leaves the trie: ``l``, the turns it shares with it, and the path that has these."""
    by_handle = nodes.withColumn("f", two_fattest("p", "e")).select(
        "path", "level", "p", "e", "f", F.expr("edge[f - p - 1]").alias("at_f"), F.expr("edge[e - p - 1]").alias("at_e")
    )
    found = batch.withColumn("r", F.col("n"))
    for i in range(steps):
        # those that have ended are dealt out evenly and meet no node
        going = F.col("l") < F.col("r")
        found = found.withColumn("f", F.when(going, two_fattest("l", "r")).otherwise(-1))
        probe = F.expr("element_at(keys, nullif(greatest(f, 0), 0))")
        found = found.withColumns({"fh": F.coalesce(probe["high"], F.xxhash64("id")), "fl": F.coalesce(probe["low"], F.col("id"))})
        node = by_handle.select(*(F.col(c).alias(f"_{c}{i}") for c in by_handle.columns))
        name = {c: F.col(f"_{c}{i}") for c in by_handle.columns}
        found = found.join(
            node, (F.col("f") == name["f"]) & (F.col("fh") == name["at_f"]["high"]) & (F.col("fl") == name["at_f"]["low"]), "left"
        )
        hit = name["p"].isNotNull()
        whole = hit & (name["e"] <= F.col("n")) & (F.expr(f"element_at(keys, least(_e{i}, n))") == name["at_e"])
        found = found.select(
            "id", "n", "keys",
            F.when(whole, name["e"]).when(hit, name["p"]).otherwise(F.col("l")).alias("l"),
            F.when(whole, F.col("r")).when(hit, name["p"]).when(going, F.col("f") - 1).otherwise(F.col("r")).alias("r"),
            F.when(whole, name["path"]).otherwise(F.col("path")).alias("path"),
            F.when(whole, name["level"]).otherwise(F.col("level")).alias("level"),
        )
    below = nodes.select(*(F.col(c).alias(f"_{c}") for c in ("path", "level", "p", "edge")), F.col("edge")[0].alias("_first"))
    more = F.col("l") < F.col("n")
    following = F.expr("element_at(keys, least(l + 1, n))")
    found = found.withColumns(
        {
            "c": F.when(more, F.col("l")).otherwise(-1),
            "ch": F.when(more, following["high"]).otherwise(F.xxhash64("id")),
            "cl": F.when(more, following["low"]).otherwise(F.col("id")),
        }
    )
    found = found.join(
        below, (F.col("c") == F.col("_p")) & (F.col("ch") == F.col("_first")["high"]) & (F.col("cl") == F.col("_first")["low"]), "left"
    )
    inside = F.col("_path").isNotNull()
    shared = _common("slice(keys, l + 1, size(_edge))", "_edge")
    return found.select(
        "id", "n", "keys",
        (F.col("l") + F.when(inside, shared).otherwise(0)).alias("l"),
        F.when(inside, F.col("_path")).otherwise(F.col("path")).alias("path"),
        F.when(inside, F.col("_level")).otherwise(F.col("level")).alias("level"),
    )


def _grow(pending: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A new path for each group of conversations that leave the trie, and how far each of the group follows it."""
    following = F.expr("element_at(keys, l + 1)")
    keyed = pending.withColumns({"h": following["high"], "w": following["low"]})
    chosen = F.min_by(F.struct("id", "n", "keys", "path", "level"), F.struct(F.xxhash64("id"), "id"))
    one = keyed.groupBy("l", "h", "w").agg(chosen.alias("one"))
    new = one.select(
        F.col("one.id").alias("path"), F.col("one.path").alias("hang"), "l", F.col("one.n").alias("n"),
        (F.col("one.level") + 1).alias("level"), F.expr("slice(one.keys, l + 1, one.n - l)").alias("edge"), "h", "w",
    )
    new = stored(new, "paths")
    other = new.select(F.col("path").alias("_path"), F.col("level").alias("_level"), F.col("edge").alias("_edge"), "l", "h", "w")
    met = keyed.join(other, ["l", "h", "w"])
    shared = _common("slice(keys, l + 1, size(_edge))", "_edge")
    moved = met.select("id", "n", "keys", (F.col("l") + shared).alias("l"), F.col("_path").alias("path"), F.col("_level").alias("level"))
    return new, stored(moved, "moved")


def _insert(classes: DataFrame) -> tuple[DataFrame | None, DataFrame | None, int]:
    """All paths (path, hang, l, n, level), where each class ends (id, path, m), and the largest level.

    A path begins below depth ``l`` of the path ``hang``, null at the root; its level is one more than that of ``hang``.
    """
    longest = classes.agg(F.max("n")).first()[0] or 0
    nothing = [F.lit(0).alias("l"), F.lit(None).cast("bigint").alias("path"), F.lit(0).alias("level")]
    place = F.pmod(F.xxhash64("id", F.lit("batch")), F.lit(sum(BATCHES)))
    nodes, paths, ends = None, [], []
    for i, share in enumerate(BATCHES):
        begin = sum(BATCHES[:i])
        pending = classes.where((F.col("n") > 0) & (place >= begin) & (place < begin + share)).select("id", "n", "keys", *nothing)
        if nodes is not None:
            found = stored(_locate(pending, nodes, longest.bit_length()), "located")
            ends.append(found.where("l = n"))
            pending = found.where("l < n")
        grown = []
        while not pending.isEmpty():
            new, moved = _grow(pending)
            grown.append(new)
            ends.append(moved.where("l = n"))
            pending = moved.where("l < n")
        paths += grown
        if grown and i + 1 < len(BATCHES):
            new = reduce(DataFrame.unionByName, grown)
            leaves = new.select("path", "level", F.col("l").alias("p"), F.col("n").alias("e"), "edge")
            every = leaves if nodes is None else nodes.unionByName(leaves)
            places = new.where("l > 0").select(F.col("hang").alias("path"), F.col("l").alias("m"))
            nodes = stored(_cut(every, places), "nodes")
    if not paths:
        return None, None, 0
    every = reduce(DataFrame.unionByName, paths).select("path", "hang", "l", "n", "level")
    ends = reduce(DataFrame.unionByName, ends).select("id", "path", F.col("l").alias("m"))
    return every, ends, every.agg(F.max("level")).first()[0]


class Paths:
    """Numbers along some paths, one row for each depth of each, from what ends or hangs there."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        self.batch = batch
        self.low = batch.column("l").to_numpy().astype(np.int64)
        self.length = batch.column("n").to_numpy().astype(np.int64) - self.low
        self.end = np.cumsum(self.length)
        self.begin = self.end - self.length
        self.row = np.repeat(np.arange(batch.num_rows), self.length)
        self.depth = np.arange(len(self.row)) - self.begin[self.row] + self.low[self.row] + 1
        lists = batch.column("events")
        self.events = lists.flatten()
        owner = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
        self.at = self.begin[owner] + self._event("m") - self.low[owner] - 1
        self.kids = self._spread("kids")
        self.n_convs = self._below(self._spread("n_convs"))
        childless = np.zeros(len(self.row), np.int64)
        childless[self.end - 1] = self.kids[self.end - 1] == 0
        self.n_leaves = self._below(self._spread("n_leaves") + childless)
        self.kids[np.arange(len(self.row)) != self.end[self.row] - 1] += 1
        size = batch.column("sizes").flatten().to_numpy()
        self.saved = self._below(self._spread("saved") + (self.n_convs - 1) * size)
        self.first = np.full(len(self.row), np.iinfo(np.int64).max)
        np.minimum.at(self.first, self.at, self._event("first"))
        reach = 1
        while reach < self.length.max(initial=0):
            near = np.flatnonzero(np.arange(len(self.row)) + reach < self.end[self.row])
            self.first[near] = np.minimum(self.first[near], self.first[near + reach])
            reach *= 2

    def _event(self, name: str) -> np.ndarray:
        return self.events.field(name).to_numpy().astype(np.int64)

    def _spread(self, name: str) -> np.ndarray:
        out = np.zeros(len(self.row), np.int64)
        np.add.at(out, self.at, self._event(name))
        return out

    def _below(self, values: np.ndarray) -> np.ndarray:
        """Sums from each depth to the end of its path."""
        sums = np.append(0, np.cumsum(values))
        return sums[self.end[self.row]] - sums[:-1]


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each path adds to the place it hangs at."""
    for batch in batches:
        paths, rows = Paths(batch), batch.num_rows
        numbers = [pa.array(x[paths.begin]) for x in (paths.n_convs, paths.first, paths.n_leaves, paths.saved)]
        yield pa.record_batch(
            [batch.column("hang"), batch.column("l"), *numbers, pa.array(np.ones(rows, np.int64)), pa.nulls(rows, pa.string())],
            names=[part.split()[0] for part in _EVENT.split(", ")],
        )


_NODE = (
    "path bigint, depth bigint, conv_id bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, "
    "n_leaves bigint, saved_tokens bigint, ends_sha256 string, hang bigint, l int"
)


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        paths = Paths(batch)
        top = np.zeros(len(paths.row), bool)
        top[paths.begin] = True
        digest = np.full(len(paths.row), _EMPTY, object)
        texts = paths.events.field("digest").to_numpy(zero_copy_only=False)
        known = np.array([t is not None for t in texts], bool)
        digest[paths.at[known]] = texts[known]
        parent = pa.array(np.append(0, paths.first[:-1])[: len(top)], mask=top)
        row = pa.array(paths.row)
        yield pa.record_batch(
            [
                batch.column("path").take(row), pa.array(paths.depth), pa.array(paths.first), parent, pa.array(paths.n_convs),
                pa.array(paths.kids), pa.array(paths.n_leaves), pa.array(paths.saved), pa.array(digest, pa.string()),
                batch.column("hang").take(row), batch.column("l").take(row),
            ],
            names=[part.split()[0] for part in _NODE.split(", ")],
        )


def _with_events(paths: DataFrame, events: DataFrame) -> DataFrame:
    """Paths with what ends or hangs at each depth, one entry for each depth."""
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_leaves", "saved", "kids")]
    places = events.where("m > 0").groupBy("path", "m").agg(*sums, F.min("first").alias("first"), F.max("digest").alias("digest"))
    fields = F.struct("m", "n_convs", "first", "n_leaves", "saved", "kids", "digest")
    lists = places.groupBy(F.col("path").alias("of")).agg(F.collect_list(fields).alias("events"))
    return paths.join(lists, F.col("path") == F.col("of")).drop("of")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of all ``conversations`` (conv_id, turns; see ``sequences``).

    A node is a distinct sequence of the first turns of a conversation, the root has none. Returns conv_id
    (smallest of the conversations that begin with it), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves
    (childless nodes below it, itself included), saved_tokens (over the nodes below it and itself, the bytes of the last
    text times all conversations but one) and ends_sha256 (of the ids that end here, joined by commas).
    Conversations without turns end at the root; an empty table has no node. conv_id must be unique.
    """
    with workspace(conversations.sparkSession):
        hashed = stored(conversations.mapInArrow(_hash_prefixes, f"conv_id bigint, n int, keys {_KEYS}, sizes array<bigint>"), "prefixes")
        classes = stored(_classes(hashed), "classes")
        paths, ends, levels = _insert(classes)
        zero = F.lit(0).cast("bigint")
        about = classes.select("id", F.col("members").alias("n_convs"), F.col("id").alias("first"), zero.alias("n_leaves"), zero.alias("saved"), zero.alias("kids"), "digest")
        names = [part.split()[0] for part in _EVENT.split(", ")]
        at_root = classes.where("n = 0").select("id", F.lit(None).cast("bigint").alias("path"), F.lit(0).alias("m"))
        ends = at_root if ends is None else ends.unionByName(at_root)
        events = stored(ends.join(about, "id").select(*names), "ends")
        if paths is not None:
            sizes = classes.select(F.col("id").alias("of"), "sizes")
            rows = paths.join(sizes, F.col("path") == F.col("of")).drop("of")
            paths = stored(rows.withColumn("sizes", F.expr("slice(sizes, l + 1, n - l)")), "sized")
        for level in range(levels, 0, -1):
            own = _with_events(paths.where(F.col("level") == level), events)
            totals = own.select("hang", "l", "n", "sizes", "events").mapInArrow(_totals, _EVENT)
            events = events.unionByName(stored(totals, "totals"))
        root = events.where("m = 0").agg(
            F.min("first").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("kids").alias("n_children"),
            F.greatest(F.sum("n_leaves"), F.lit(1)).alias("n_leaves"), F.sum("saved").alias("saved_tokens"),
            F.coalesce(F.max("digest"), F.lit(_EMPTY)).alias("ends_sha256"),
        ).where("n_convs is not null")
        root = root.select("conv_id", zero.alias("depth"), F.lit(None).cast("bigint").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
        if paths is None:
            return stored(root, "trie", keep=True)
        below = _with_events(paths, events).select("path", "hang", "l", "n", "sizes", "events")
        below = stored(below.mapInArrow(_expand, _NODE), "expanded")
        return stored(_with_parents(below, root), "trie", keep=True)


def _with_parents(below: DataFrame, root: DataFrame) -> DataFrame:
    """All nodes; the first one of a path takes its parent from the path it hangs at."""
    least = root.first()["conv_id"]
    tops = below.where("parent_conv_id is null")
    inner = below.select(F.col("path").alias("_path"), F.col("depth").alias("_depth"), F.col("conv_id").alias("_parent"))
    hung = tops.where("l > 0").drop("parent_conv_id")
    hung = hung.join(inner, (F.col("hang") == F.col("_path")) & (F.col("l") == F.col("_depth")))
    parts = [
        root,
        below.where("parent_conv_id is not null"),
        tops.where("l = 0").withColumn("parent_conv_id", F.lit(least).cast("bigint")),
        hung.withColumn("parent_conv_id", F.col("_parent")),
    ]
    return reduce(DataFrame.unionByName, [part.select(*root.columns) for part in parts])


def rebuilt(conversations: DataFrame) -> DataFrame:
    """Conversations that share beginnings: the first h turns of c - c % 5, then c's own after its first h.

    h is the CRC-32 of the decimal c, modulo 9. From a shorter conversation all turns are taken, from an absent one none.
    """
    taken = F.expr("cast(crc32(cast(conv_id as string)) % 9 as int)")
    own = conversations.withColumns({"h": taken, "from": F.expr("conv_id - conv_id % 5")})
    heads = conversations.select(F.col("conv_id").alias("of"), F.slice("turns", 1, 8).alias("head"))
    both = own.join(heads, F.col("from") == F.col("of"), "left")
    turns = "concat(slice(coalesce(head, array()), 1, h), slice(turns, h + 1, greatest(size(turns) - h, 0)))"
    return both.select("conv_id", F.expr(turns).alias("turns"))
