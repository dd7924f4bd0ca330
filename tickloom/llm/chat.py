"""Chat formatting over a prefix tree (operator 6).

Conversations that begin with the same turns share them. A node of the tree is a turn with all turns
before it, known by a 128-bit hash of these. Each node is formatted and tokenized once, however many
conversations pass through it. The nodes are laid out depth-first as one stream of tokens: a node is followed by
its children's subtrees. Each has position ids that count on from its parent, and the intervals of
the stream that its tokens may attend to besides their own: the tokens of its ancestors.

To get the depth-first order from a distributed sort, turns between two forks form a segment, and a node's
sort key is the chain of segment hashes that lead to it, then its depth. A tree with very many
conversations is thus spread over as many tasks as its keys need.

Template: ``[INST] text [/INST]`` for a user, ``text</s>`` for an assistant, and
``[ROLE]role[/ROLE]text</s>`` for any other role. In texts and role names a backslash is put before
backslashes and into control strings, which unescaping takes out again. Loss falls on the assistant's
text only.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from public_tokenizers import PATTERN
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.shared import stored, workspace
from tickloom.llm.words import slices

CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]", "<<SYS>>", "<</SYS>>")
_FIND = re.compile("|".join(map(re.escape, CONTROL)))
_OTHER = re.compile(r"\[ROLE\](.*?)\[/ROLE\](.*)</s>", re.DOTALL)


def escape(text: str) -> str:
    return _FIND.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def format_turn(role: str, text: str) -> tuple[str, str, str]:
    """What stands before the escaped text, the text, and what follows it."""
    body = escape(text)
    if role == "user":
        return "[INST] ", body, " [/INST]"
    if role == "assistant":
        return "", body, "</s>"
    return f"[ROLE]{escape(role)}[/ROLE]", body, "</s>"


def parse_turn(formatted: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    if formatted.startswith("[INST] ") and formatted.endswith(" [/INST]"):
        return "user", unescape(formatted[7:-8])
    other = _OTHER.fullmatch(formatted)
    if other:
        return unescape(other[1]), unescape(other[2])
    return "assistant", unescape(formatted.removesuffix("</s>"))


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The node of every turn, from whole conversations."""
    kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.string(), pa.string()]
    names = ["conv_id", "conv", "depth", "turns", "key", "parent", "role", "text"]
    for batch in batches:
        out: list[list] = [[] for _ in names]
        size = 0
        for conv_id, turns in zip(batch.column("conv_id").to_pylist(), batch.column("turns")):
            conv = hashlib.blake2b(repr(conv_id).encode(), digest_size=16).digest()
            key = b""
            own = turns.as_py()
            for depth, turn in enumerate(own):
                role, text = turn["role"] or "", turn["text"] or ""
                parent = key
                raw = [parent, role.encode(), text.encode()]
                key = hashlib.blake2b(b"".join(len(r).to_bytes(8, "little") + r for r in raw), digest_size=16).digest()
                for column, value in zip(out, (conv_id, conv, depth, len(own), key, parent, role, text)):
                    column.append(value)
                size += len(text)
            if size > 4 << 20:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(out, kinds)], names=names)
                out, size = [[] for _ in names], 0
        if out[0]:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(out, kinds)], names=names)


def ranks(vocabulary: str) -> dict[bytes, int]:
    """Bytes and id of each token of a vocabulary file (base64 and number on each line)."""
    with open(vocabulary, "rb") as lines:
        return {base64.b64decode(word): int(number) for word, number in map(bytes.split, lines)}


@lru_cache(maxsize=1)
def encoding(vocabulary: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("chat", pat_str=PATTERN, mergeable_ranks=ranks(vocabulary), special_tokens={})


def byte_table(vocabulary: str) -> list[bytes]:
    """The bytes of every id."""
    words = ranks(vocabulary)
    table = [b""] * (max(words.values()) + 1)
    for word, number in words.items():
        table[number] = word
    return table


def _tokens(vocabulary: str):
    def coded(encoder: tiktoken.Encoding, role: str, text: str) -> tuple[np.ndarray, np.ndarray]:
        pieces = [encoder.encode_ordinary(p) for p in format_turn(role, text)]
        loss = np.repeat([False, role == "assistant", False], [len(p) for p in pieces])
        return np.array([i for p in pieces for i in p], np.int32), loss

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoding(vocabulary)
        for batch in batches:
            for part in slices(batch, "text"):
                turns = zip(part.column("role").to_pylist(), part.column("text").to_pylist())
                lists = [coded(encoder, role, text) for role, text in turns]
                edges = pa.array(np.cumsum([0, *(len(ids) for ids, _ in lists)]), pa.int32())
                ids, loss = (pa.array(np.concatenate(flat)) for flat in zip(*lists))
                columns = [pa.ListArray.from_arrays(edges, flat) for flat in (ids, loss)]
                yield pa.record_batch([part.column("key"), *columns], names=["key", "ids", "loss"])

    return run


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segment, chain of segments and first position of every node of a conversation."""
    names = ["key", "path", "depth", "position"]
    kinds = [pa.binary(), pa.binary(), pa.int32(), pa.int64()]
    for batch in batches:
        for whole in batch.column("chain"):
            chain = whole.as_py()
            out: list[list] = [[] for _ in names]
            path, position, waiting = b"", 0, []
            for node in chain:
                waiting.append((node["key"], node["depth"], position))
                position += node["size"]
                if node["cut"]:
                    path += waiting[0][0]
                    for key, depth, at in waiting:
                        for column, value in zip(out, (key, path, depth, at)):
                            column.append(value)
                    waiting = []
            yield pa.record_batch([pa.array(c, k) for c, k in zip(out, kinds)], names=names)


def _offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sorted nodes of a task with the tokens before each in the task."""
    before = 0
    for batch in batches:
        size = batch.column("size").to_numpy()
        local = before + np.cumsum(size) - size
        before += int(size.sum())
        shard = pa.array(np.full(batch.num_rows, TaskContext.get().partitionId(), np.int32))
        yield pa.RecordBatch.from_arrays([*batch.columns, shard, pa.array(local)], names=[*batch.schema.names, "shard", "local"])


def build_tree(turns: DataFrame, vocabulary: str) -> tuple[DataFrame, DataFrame]:
    """The tree of ``turns`` (conv_id, turn, role, text) and the members of it.

    Tree: one row per node, with shard and start (its order and place in the stream), key, parent (empty for a
    first turn), depth, position (of its first token), ids, loss, attends (intervals of the stream,
    in order, neighbours joined). Members: (conv, conv_id, depth, turns, key), one row per turn.

    Turns of a conversation are taken by turn, then role and text; all of them count, repeated ones too. Null
    text and role are empty. Rows without conv_id form one conversation. An empty table gives an
    empty tree. ``vocabulary`` is the path of a byte-level vocabulary (lines of base64 and rank), so that
    decoding gives the text back; strings of special tokens are ordinary text to it.
    """
    with workspace(turns.sparkSession):
        return _build_tree(turns, vocabulary)


def _build_tree(turns: DataFrame, vocabulary: str) -> tuple[DataFrame, DataFrame]:
    rows = turns.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text")
    # the turns of one conversation
    talks = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    chains = stored(
        talks.mapInArrow(
            _chain,
            "conv_id bigint, conv binary, depth int, turns int, key binary, parent binary, role string, text string",
        ),
        "chains",
        keep=True,
    )
    nodes = chains.groupBy("key").agg(
        *(F.first(c).alias(c) for c in ("parent", "role", "text")),
        F.max((F.col("depth") == F.col("turns") - 1).cast("int")).alias("ends"),
    )
    nodes = stored(nodes, "nodes")
    coded = nodes.select("key", "role", "text").mapInArrow(
        _tokens(vocabulary), "key binary, ids array<int>, loss array<boolean>"
    )
    coded = stored(coded, "coded")
    forks = nodes.groupBy("parent").agg(F.count("*").alias("children"))
    shape = (
        nodes.select("key", "ends")
        .join(forks.withColumnRenamed("parent", "key"), "key", "left")
        .join(coded.select("key", F.size("ids").cast("bigint").alias("size")), "key")
        .select("key", "size", ((F.col("ends") == 1) | (F.coalesce("children", F.lit(0)) != 1)).alias("cut"))
    )
    shape = stored(shape, "shape")
    members = chains.select("conv", "conv_id", "depth", "turns", "key")
    # one conversation of those that end at the same node gives the paths of its nodes
    ends = members.where("depth = turns - 1").groupBy("key").agg(F.min("conv").alias("conv")).select("conv").distinct()
    chain = F.array_sort(F.collect_list(F.struct("depth", "key", "size", "cut"))).alias("chain")
    paths = (
        members.join(ends, "conv").join(shape, "key").groupBy("conv").agg(chain).select("chain").mapInArrow(
            _paths, "key binary, path binary, depth int, position bigint"
        )
    )
    paths = paths.groupBy("key").agg(*(F.first(c).alias(c) for c in ("path", "depth", "position")))
    sized = paths.join(shape.select("key", "size"), "key").repartitionByRange("path", "depth").sortWithinPartitions("path", "depth")
    placed = stored(
        sized.mapInArrow(
            _offsets, "key binary, path binary, depth int, position bigint, size bigint, shard int, local bigint"
        ),
        "placed",
    )
    totals = placed.groupBy("shard").agg(F.sum("size").alias("total"))
    before = F.sum("total").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    bases = totals.select("shard", F.coalesce(before, F.lit(0)).alias("base"))
    placed = stored(placed.join(bases, "shard").withColumn("start", F.col("base") + F.col("local")), "starts")
    segments = placed.groupBy("path").agg(
        F.min("start").alias("first"), F.max(F.col("start") + F.col("size")).alias("last")
    )
    up = F.explode(F.sequence(F.lit(16), F.octet_length("path") - 16, F.lit(16)))
    lengths = segments.where(F.octet_length("path") > 16).select("path", up.alias("length"))
    above = (
        lengths.select("path", F.expr("substring(path, 1, length)").alias("upper"))
        .join(segments.withColumnRenamed("path", "upper"), "upper")
        .groupBy("path")
        .agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("above"))
    )
    none = F.array().cast("array<struct<first:bigint,last:bigint>>")
    own = F.struct(F.col("first"), F.col("start").alias("last"))
    every = F.concat(F.coalesce("above", none), F.when(F.col("start") > F.col("first"), F.array(own)).otherwise(none))
    joined = F.aggregate(
        every,
        none,
        lambda done, x: F.when(
            (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["last"] == x["first"]),
            F.concat(
                F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))),
                F.array(F.struct(F.try_element_at(done, F.lit(-1))["first"].alias("first"), x["last"].alias("last"))),
            ),
        ).otherwise(F.concat(done, F.array(x))),
    )
    tree = (
        placed.join(segments.select("path", "first"), "path")
        .join(above, "path", "left")
        .join(coded, "key")
        .join(nodes.select("key", "parent"), "key")
        .select("shard", "start", "key", "parent", "depth", "position", "ids", "loss", joined.alias("attends"))
    )
    return stored(tree, "tree", keep=True), members


def _read(table: list[bytes]):
    def decoded(ids: list[int]) -> str:
        return b"".join([table[i] for i in ids]).decode("utf-8", "replace")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv_id, nodes in zip(batch.column("conv_id").to_pylist(), batch.column("nodes")):
                turns, loss, size = hashlib.sha256(), [], 0
                for node in nodes.as_py():
                    formatted = decoded(node["ids"])
                    size += len(formatted)
                    role, text = parse_turn(formatted)
                    turns.update(f"{role}\n{text}\n".encode())
                    learned = [i for i, own in zip(node["ids"], node["loss"]) if own]
                    if learned:
                        loss.append(unescape(decoded(learned)))
                learned = "".join(loss)
                digest = hashlib.sha256(learned.encode()).hexdigest()
                rows.append((conv_id, len(nodes), turns.hexdigest(), len(learned), digest, size))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            columns = list(zip(*rows)) or [[]] * len(kinds)
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return run


def read_conversations(tree: DataFrame, members: DataFrame, vocabulary: str) -> DataFrame:
    """What each conversation says, read back from the tokens of its nodes.

    conv_id, n_turns, turns_sha256 (of role, line end, text, line end for each turn), loss_chars and
    loss_sha256 (of all text under the loss mask), formatted_chars.
    """
    nodes = F.array_sort(F.collect_list(F.struct("depth", "ids", "loss"))).alias("nodes")
    whole = members.join(tree.select("key", "ids", "loss"), "key").groupBy("conv").agg(F.first("conv_id").alias("conv_id"), nodes)
    return whole.select("conv_id", "nodes").mapInArrow(
        _read(byte_table(vocabulary)),  # some 50,000 short strings
        "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
    )
