"""Repeated passages by FM-indexes over shards (operator 10).

A passage is a window of ``window`` consecutive words. To find equal windows without looking at every
shard for every document, each window is sent to one shard, which its words decide: the smallest
hash among its runs of ``GRAM`` words. Neighbouring windows mostly agree in it and travel together as
a stretch. Equal windows always meet.

1. Stretches whose hash occurs in one document only are dropped; they cannot repeat.
2. Equal stretches (of copies and passages, however many) are resolved by the smallest doc_id that
   has them, with partial sums; that document keeps one for all.
3. Where different stretches share a hash, their words are cut from the texts and indexed. Hashes with very many
   stretches are first split by longer runs (``LONG``), which again come from the words of each window.
   What then still has more than ``FULL`` words under one key is no longer indexed: each of its windows is known by a
   hash of all its words, and the smallest doc_id of each is found with partial sums.
4. In each block of a shard an FM-index (``fm_index``) is built, and the stretches are streamed
   through it by backward search. Windows whose interval holds a smaller doc_id are reported.
5. The reported intervals are joined to the documents, and their words removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.fm_index import DEPTH, FMIndex
from tickloom.llm.shared import stored, workspace
from tickloom.llm.words import BLANK, Words, mix, slices, split

GRAM, LONG = 20, 36
#: Windows in a stretch at most.
STRETCH = 64
#: Stretches of a hash from which on it is split by longer runs.
MANY = 2048
#: Words in one index, at most ``FULL`` more.
INDEXED = 1 << 20
#: Words of a key from which on its windows are compared by hash.
FULL = 1 << 18
#: The place of rows without doc_id: after all others.
LAST = (1 << 63) - 1

_STEP = np.uint64(0xD6E8FEB86659FD93)
_RUNS = "hash bigint, content bigint, doc bigint, text_id bigint, start int, windows int"


def _rolling(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each place on; the last places are meaningless."""
    out = np.zeros(len(hashes), np.uint64)
    for k in range(min(size, len(hashes))):
        out[: len(hashes) - k] = out[: len(hashes) - k] * _STEP + hashes[k:]
    return mix(out)


def _least(values: np.ndarray, size: int) -> np.ndarray:
    """Smallest of the ``size`` values from each place on."""
    out, span = values.copy(), 1
    while span < size:
        step = min(span, size - span)
        head = out[: max(0, len(out) - step)]
        np.minimum(head, out[step:], out=head)
        span += step
    return out


def _stretches(hashes: np.ndarray, first: np.ndarray, window: int, gram: int):
    """Text, first word, number of windows and smallest hash of each stretch."""
    counts = np.diff(first)
    least = _least(_rolling(hashes, gram), window - gram + 1)
    number = np.maximum(counts - window + 1, 0)
    text = np.repeat(np.arange(len(counts)), number)
    inner = np.arange(len(text)) - np.repeat(np.cumsum(number) - number, number)
    place = first[:-1][text] + inner
    own = least[place]
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (text[1:] != text[:-1])
    begin = np.flatnonzero(new)
    run = np.arange(len(own)) - np.repeat(begin, np.diff(np.append(begin, len(own))))
    begin = np.flatnonzero(run % STRETCH == 0)
    size = np.diff(np.append(begin, len(own)))
    return text[begin], inner[begin], size, own[begin]


def _contents(words: Words, text: np.ndarray, start: np.ndarray, size: np.ndarray, window: int) -> np.ndarray:
    """A hash of the words that the windows of each stretch cover."""
    at = words.first[:-1][text] + start
    length = size + window - 1
    # from the hashes of runs that cover the stretch: its first and last ones, by doubling
    half, span = words.hash, 1
    out = np.zeros(len(at), np.uint64)
    longest = int(length.max(initial=0))
    while span <= longest:
        own = (length >= span) & (length < 2 * span)
        out[own] = mix(half[at[own]] * _STEP + half[at[own] + length[own] - span]) + length[own].astype(np.uint64)
        if 2 * span <= longest:
            ahead = np.zeros(len(half), np.uint64)
            ahead[:-span] = half[span:]
            half = mix(half * _STEP + ahead)
        span *= 2
    return out


def _runs(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = split(part.column("text"), BLANK)
                text, start, size, least = _stretches(words.hash, words.first, window, GRAM)
                rows = pa.array(text)
                yield pa.record_batch(
                    [
                        pa.array(least.view(np.int64)),
                        pa.array(_contents(words, text, start, size, window).view(np.int64)),
                        part.column("doc").take(rows),
                        part.column("text_id").take(rows),
                        pa.array(start.astype(np.int32)),
                        pa.array(size.astype(np.int32)),
                    ],
                    names=["hash", "content", "doc", "text_id", "start", "windows"],
                )

    return run


def _cut(window: int):
    """The words of the wanted stretches, as word hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = split(part.column("text"), BLANK)
                wanted = part.column("wanted")
                row = np.repeat(np.arange(part.num_rows), wanted.value_lengths().to_numpy())
                flat = wanted.flatten()
                start, size = (flat.field(c).to_numpy() for c in ("start", "windows"))
                at = words.first[:-1][row] + start
                length = size.astype(np.int64) + window - 1
                edges = np.concatenate([[0], np.cumsum(length)])
                take = np.repeat(at - edges[:-1], length) + np.arange(edges[-1])
                yield pa.record_batch(
                    [
                        flat.field("hash"),
                        flat.field("content"),
                        part.column("doc").take(pa.array(row)),
                        flat.field("hot"),
                        pa.ListArray.from_arrays(
                            pa.array(edges.astype(np.int32)), pa.array(words.hash[take].view(np.int64))
                        ),
                    ],
                    names=["hash", "content", "doc", "hot", "words"],
                )

    return run


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]).astype(np.int64)
    return lists.flatten().to_numpy().view(np.uint64), edges


def _resplit(window: int):
    """Stretches of hot hashes are split by the smallest hash of longer runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, edges = _flat(batch.column("words"))
            hot = batch.column("hot").to_numpy(zero_copy_only=False).astype(bool)
            row, start, size, least = _stretches(hashes, edges, window, LONG)
            own = batch.column("hash").to_numpy().view(np.uint64)
            keep = hot[row]
            cold = np.flatnonzero(~hot)
            row = np.concatenate([row[keep], cold])
            start = np.concatenate([start[keep], np.zeros(len(cold), np.int64)])
            length = np.concatenate([size[keep] + window - 1, np.diff(edges)[cold]])
            key = np.concatenate([mix(own[row[: keep.sum()]] + least[keep]), own[cold]])
            out = np.concatenate([[0], np.cumsum(length)])
            take = np.repeat(edges[:-1][row] + start - out[:-1], length) + np.arange(out[-1])
            rows = pa.array(row)
            yield pa.record_batch(
                [
                    pa.array(key.view(np.int64)),
                    batch.column("hash").take(rows),
                    batch.column("content").take(rows),
                    batch.column("doc").take(rows),
                    pa.array(start.astype(np.int32)),
                    pa.ListArray.from_arrays(pa.array(out.astype(np.int32)), pa.array(hashes[take].view(np.int64))),
                ],
                names=["key", "hash", "content", "doc", "offset", "words"],
            )

    return run


def _whole_windows(window: int):
    """Each window of the stretches by a hash of all its words; with the key, 128 bits stand for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, edges = _flat(batch.column("words"))
            number = np.maximum(np.diff(edges) - window + 1, 0)
            row = np.repeat(np.arange(batch.num_rows), number)
            inner = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
            value = _rolling(hashes, window)[edges[:-1][row] + inner]
            rows = pa.array(row)
            offset = batch.column("offset").to_numpy()[row] + inner
            yield pa.record_batch(
                [
                    *(batch.column(c).take(rows) for c in ("key", "hash", "content", "doc")),
                    pa.array(offset.astype(np.int32)),
                    pa.array(value.view(np.int64)),
                ],
                names=["key", "hash", "content", "doc", "offset", "value"],
            )

    return run


def _search(window: int):
    """Index the stretches of a block, stream them through it, and report windows of smaller docs."""

    def block(table: pa.Table) -> pa.RecordBatch:
        hashes, edges = _flat(table["words"].combine_chunks())
        doc = table["doc"].to_numpy()
        index = FMIndex(hashes, edges, doc, window)
        found = index.windows(hashes, edges)
        row = np.repeat(np.arange(len(doc)), np.diff(edges))
        hit = found >= 0
        hit[hit] = index.least_owner[found[hit]] < doc[row[hit]]
        # runs of reported windows
        edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
        begin, end = edge[0::2], edge[1::2]
        rows = pa.array(row[begin])
        offset = table["offset"].to_numpy()[row[begin]]
        return pa.record_batch(
            [
                table["hash"].combine_chunks().take(rows),
                table["content"].combine_chunks().take(rows),
                table["doc"].combine_chunks().take(rows),
                pa.array((begin - edges[row[begin]] + offset).astype(np.int32)),
                pa.array((end - begin).astype(np.int32)),
            ],
            names=["hash", "content", "doc", "offset", "found"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        have = 0
        for batch in batches:
            keys = batch.column("key").to_numpy()
            at = 0
            for i in [*(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), batch.num_rows]:
                if have >= INDEXED and keys[at] != waiting[-1].column("key")[-1].as_py():
                    yield block(pa.Table.from_batches(waiting))
                    waiting, have = [], 0
                piece = batch.slice(at, i - at)
                waiting.append(piece)
                have += int(np.sum(piece.column("words").value_lengths().to_numpy()))
                at = i
        if have:
            yield block(pa.Table.from_batches(waiting))

    return run


def _removed(window: int, keep_text: bool):
    """Words of each text, how many are covered, and a digest of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                total, gone, digests, kept_texts = [], [], [], []
                spans = part.column("spans").to_pylist()
                for text, own in zip(part.column("text").cast(pa.binary()).to_pylist(), spans):
                    words = (text or b"").split()
                    total.append(len(words))
                    if own:
                        cover = np.zeros(len(words) + 1, np.int64)
                        for s in own:
                            cover[s["start"]] += 1
                            cover[s["start"] + s["found"] + window - 1] -= 1
                        keep = np.cumsum(cover[:-1]) == 0
                        words = [w for w, k in zip(words, keep.tolist()) if k]
                    gone.append(total[-1] - len(words))
                    kept = b" ".join(words)
                    digests.append(hashlib.sha256(kept).hexdigest())
                    kept_texts.append(kept.decode("utf-8", "replace") if keep_text else None)
                yield pa.record_batch(
                    [
                        part.column("doc_id"),
                        pa.array(total, pa.int64()),
                        pa.array(gone, pa.int64()),
                        pa.array(digests, pa.string()),
                        pa.array(kept_texts, pa.string()),
                    ],
                    names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
                )

    return run


def repeated_spans(docs: DataFrame, window: int = 50) -> DataFrame:
    """(doc, text_id, start, found): ``found`` windows from word ``start`` on also start in a smaller doc."""
    if not LONG < window < DEPTH:
        raise ValueError(f"a window has {LONG + 1} to {DEPTH - 1} words")
    with workspace(docs.sparkSession):
        return stored(_repeated_spans(docs, window), "spans", keep=True)


def _repeated_spans(docs: DataFrame, window: int) -> DataFrame:
    rows = docs.select("doc", "text_id", "text")
    runs = rows.mapInArrow(_runs(window), _RUNS)
    shared = (
        runs.select("hash", "doc")
        .groupBy("hash")
        .agg(F.min("doc").alias("least"), F.max("doc").alias("most"))
        .where("least < most")
        .select("hash")
    )
    runs = stored(runs.join(shared, "hash"), "stretches")
    kinds = runs.groupBy("hash", "content", "windows").agg(
        F.min(F.struct("doc", "text_id", "start")).alias("keeper")
    )
    kinds = stored(kinds, "kinds")
    copies = (
        runs.join(kinds, ["hash", "content", "windows"])
        .where("doc > keeper.doc")
        .select("doc", "text_id", "start", F.col("windows").alias("found"))
    )
    variants = kinds.groupBy("hash").agg(F.count("*").alias("many")).where("many > 1")
    wanted = (
        kinds.join(variants, "hash")
        .select("keeper.*", "windows", "hash", "content", (F.col("many") > MANY).alias("hot"))
        .groupBy("doc", "text_id")
        .agg(F.collect_list(F.struct("start", "windows", "hash", "content", "hot")).alias("wanted"))
    )  # the stretches of one document
    cut = (
        rows.join(wanted, ["doc", "text_id"])
        .dropDuplicates(["doc", "text_id"])
        .select("doc", "text", "wanted")
        .mapInArrow(_cut(window), "hash bigint, content bigint, doc bigint, hot boolean, words array<bigint>")
    )
    pieces = stored(
        cut.mapInArrow(
            _resplit(window), "key bigint, hash bigint, content bigint, doc bigint, offset int, words array<bigint>"
        ),
        "pieces",
    )
    full = pieces.groupBy("key").agg(F.sum(F.size("words")).alias("n")).where(F.col("n") > FULL).select("key")
    full = stored(full, "full")
    found = (
        pieces.join(full, "key", "left_anti")
        .repartition("key")
        .sortWithinPartitions("key")
        .mapInArrow(_search(window), "hash bigint, content bigint, doc bigint, offset int, found int")
    )
    windows = pieces.join(full, "key", "left_semi").select(*pieces.columns).mapInArrow(
        _whole_windows(window), "key bigint, hash bigint, content bigint, doc bigint, offset int, value bigint"
    )
    windows = stored(windows, "windows")
    least = windows.groupBy("key", "value").agg(F.min("doc").alias("least"), F.max("doc").alias("most"))
    common = (
        windows.join(least.where("least < most"), ["key", "value"])
        .where("doc > least")
        .select("hash", "content", "doc", "offset", F.lit(1).alias("found"))
    )
    found = stored(found.unionByName(common), "found")
    inner = runs.select("hash", "content", "doc", "text_id", "start").join(found, ["hash", "content", "doc"]).select(
        "doc", "text_id", (F.col("start") + F.col("offset")).alias("start"), "found"
    )
    return copies.unionByName(inner)


def _placed(docs: DataFrame) -> DataFrame:
    text_id: Column = F.xxhash64("text")
    return docs.select(
        F.col("doc_id").cast("bigint"), "text", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST)).alias("doc"), text_id.alias("text_id")
    )


def remove_repeats(docs: DataFrame, window: int = 50, keep_text: bool = True) -> DataFrame:
    """Remove each word inside a window of ``window`` words that also starts in a smaller doc_id.

    Words are runs of anything but ASCII white space, taken as they are. Returns one row per row of
    ``docs`` (doc_id, text): doc_id, n_words, n_removed, kept_sha256, kept_text (the kept words joined by
    one space, null unless ``keep_text``). Windows are judged on the texts as given. A null text has no words. Rows without
    doc_id come after all others, and nothing is removed among them; the same goes for rows that share
    a doc_id. An empty table gives no rows.
    """
    placed = _placed(docs)
    spans = (
        repeated_spans(placed, window)
        .groupBy("doc", "text_id")
        .agg(F.collect_list(F.struct("start", "found")).alias("spans"))
    )  # the spans of one document
    return (
        placed.join(spans, ["doc", "text_id"], "left")
        .select("doc_id", "text", "spans")
        .mapInArrow(
            _removed(window, keep_text), "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept_text string"
        )
    )
