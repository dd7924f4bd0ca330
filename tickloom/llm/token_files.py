"""Token ids as Arrow files of equal-length sequences (operator 3).

The ids of all documents, each closed by an end id, form one stream in the order of doc_id. It is cut
into sequences of ``SEQUENCE`` ids. A file holds the stream of one range of doc_ids as record
batches with two fixed-size-list columns: ``ids`` (16 bits where the vocabulary allows) and ``mask``,
which is true for ids and false for the filling at the end of a file. As every row has the same
width, sequence i lies at a place that can be computed, and a memory-mapped file gives it without
copying (``TokenFile``). A second file beside it lists doc_id, first id and number of ids of each document.

Tasks write files under names of their own; the stored manifest names those of the attempt that
counted, so a repeated task does no harm. Files are opened by URI, so the shared folder may be local
or a remote store that pyarrow knows.

A tokenizer whose pieces never span white space gives the same ids for a text as for its parts
between white space, so each distinct part is encoded once (``parts=True``). Other tokenizers get whole texts.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.ipc as ipc
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.shared import new_path, stored
from tickloom.llm.words import BLANK, slices, split

SEQUENCE = 1024
#: Sequences in a record batch.
BATCH = 256
END = 1
#: Distinct parts whose ids a task keeps.
KEPT = 1 << 19
#: Parts that are encoded as one text.
JOINED = 128

_MANIFEST = "shard int, path string, index string, n_docs bigint, n_tokens bigint, n_sequences bigint"


@lru_cache(maxsize=2)
def tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Encoder:
    """Ids of whole texts, one after the other."""

    def __init__(self, path: str, parts: bool) -> None:
        self.tokenizer = tokenizer(path)
        self.wide = self.tokenizer.get_vocab_size() > 1 << 16
        self.kind = np.dtype("<u4" if self.wide else "<u2")
        self.parts = parts
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids = np.array([END], self.kind)  # entry 0 closes a document
        self.length = np.array([1])

    def _encode_parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the parts, one after the other, and how many belong to each.

        Parts are encoded as texts of ``JOINED`` of them with spaces between; the place at which a token
        begins tells its part.
        """
        groups = [parts[i : i + JOINED] for i in range(0, len(parts), JOINED)]
        ids, counts = [], []
        for group, code in zip(groups, self.tokenizer.encode_batch([" ".join(g) for g in groups], add_special_tokens=False)):
            begin = np.cumsum([0, *(len(p) + 1 for p in group[:-1])])
            place = np.fromiter((first for first, _ in code.offsets), np.int64, len(code))
            ids.append(np.array(code.ids, self.kind))
            counts.append(np.bincount(np.searchsorted(begin, place, "right") - 1, minlength=len(group)))
        return np.concatenate(ids), np.concatenate(counts)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts with their end ids, and how many belong to each."""
        if not self.parts:
            whole = self.tokenizer.encode_batch_fast([t or "" for t in texts.to_pylist()], add_special_tokens=False)
            lists = [[*code.ids, END] for code in whole]
            flat = np.fromiter((i for ids in lists for i in ids), self.kind)
            return flat, np.array([len(ids) for ids in lists], np.int64)
        words = split(texts, BLANK)
        _, at, number = np.unique(words.hash, return_index=True, return_inverse=True)
        data = words.data.tobytes()
        parts = [data[s:e] for s, e in zip(words.start[at].tolist(), words.end[at].tolist())]
        if len(self.known) + len(parts) > KEPT:
            self._forget()
        new = [p for p in parts if p not in self.known]
        if new:
            ids, counts = self._encode_parts([p.decode("utf-8", "replace") for p in new])
            self.known.update(zip(new, range(len(self.length), len(self.length) + len(new))))
            self.length = np.concatenate([self.length, counts])
            self.ids = np.concatenate([self.ids, ids])
        entry = np.fromiter((self.known[p] for p in parts), np.int64, len(parts))
        order = np.insert(entry[number], words.first[1:], 0)
        length = self.length[order]
        first = np.cumsum(self.length) - self.length
        edges = np.concatenate([[0], np.cumsum(length)])
        flat = self.ids[np.repeat(first[order] - edges[:-1], length) + np.arange(edges[-1])]
        ends = edges[words.first[1:] + np.arange(1, len(texts) + 1)]
        return flat, np.diff(np.concatenate([[0], ends]))


def schema_of(kind: np.dtype, sequence: int) -> pa.Schema:
    ids = pa.list_(pa.from_numpy_dtype(kind), sequence)
    return pa.schema([("ids", ids), ("mask", pa.list_(pa.bool_(), sequence))])


_INDEX = pa.schema([("doc_id", pa.int64()), ("first", pa.int64()), ("n_tokens", pa.int64())])


class _Writer:
    """One file of sequences and its list of documents."""

    def __init__(self, folder: str, kind: np.dtype, sequence: int) -> None:
        name = f"{folder}/part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}"
        self.path, self.index = f"{name}.arrow", f"{name}.docs.arrow"
        store, path = FileSystem.from_uri(self.path)
        store.create_dir(os.path.dirname(path), recursive=True)
        self.streams = [store.open_output_stream(FileSystem.from_uri(p)[1]) for p in (self.path, self.index)]
        self.schema, self.kind, self.sequence = schema_of(kind, sequence), kind, sequence
        self.ids_file = ipc.new_file(self.streams[0], self.schema)
        self.docs_file = ipc.new_file(self.streams[1], _INDEX)
        self.rest, self.waiting = [], 0
        self.n_docs = self.n_tokens = self.n_sequences = 0

    def add(self, doc_ids: pa.Array, ids: np.ndarray, counts: np.ndarray) -> None:
        first = self.n_tokens + np.cumsum(counts) - counts
        self.docs_file.write_batch(
            pa.record_batch([doc_ids.cast(pa.int64()), pa.array(first), pa.array(counts)], schema=_INDEX)
        )
        self.n_docs += len(counts)
        self.n_tokens += len(ids)
        self.rest.append(ids)
        self.waiting += len(ids)
        if self.waiting >= BATCH * self.sequence:
            self._flush(BATCH * self.sequence)

    def _flush(self, unit: int) -> None:
        flat = np.concatenate(self.rest) if self.rest else np.zeros(0, self.kind)
        whole = len(flat) // unit * unit
        for at in range(0, whole, unit):
            self._write(flat[at : at + unit], unit)
        self.rest, self.waiting = [flat[whole:]], len(flat) - whole

    def _write(self, ids: np.ndarray, real: int) -> None:
        mask = np.arange(len(ids)) < real
        columns = [
            pa.FixedSizeListArray.from_arrays(pa.array(ids), self.sequence),
            pa.FixedSizeListArray.from_arrays(pa.array(mask), self.sequence),
        ]
        self.ids_file.write_batch(pa.record_batch(columns, schema=self.schema))
        self.n_sequences += len(ids) // self.sequence

    def close(self) -> pa.RecordBatch:
        last = np.concatenate(self.rest) if self.rest else np.zeros(0, self.kind)
        if len(last):
            filled = np.zeros(-(-len(last) // self.sequence) * self.sequence, self.kind)
            filled[: len(last)] = last
            self._write(filled, len(last))
        for file in (self.ids_file, self.docs_file, *self.streams):
            file.close()
        values = [TaskContext.get().partitionId(), self.path, self.index, self.n_docs, self.n_tokens, self.n_sequences]
        kinds = [pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        names = [part.split()[0] for part in _MANIFEST.split(", ")]
        return pa.record_batch([pa.array([v], k) for v, k in zip(values, kinds)], names=names)


def _write(folder: str, vocabulary: str, sequence: int, parts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, writer = Encoder(vocabulary, parts), None
        for batch in batches:
            for part in slices(batch, "text"):
                if writer is None:
                    writer = _Writer(folder, encode.kind, sequence)
                writer.add(part.column("doc_id"), *encode(part.column("text")))
        if writer is not None:
            yield writer.close()

    return run


def write_tokens(
    docs: DataFrame, vocabulary: str, sequence: int = SEQUENCE, parts: bool = True, folder: str | None = None
) -> DataFrame:
    """Write the ids of ``docs`` (doc_id, text) and return the manifest, one row per file.

    Files follow each other in the order of ``shard``, which is that of doc_id; rows without doc_id
    come last, rows with one doc_id in the order of their texts. A null text is an empty document. An
    empty table writes no file. ``vocabulary`` is the path of a tokenizers file, the same on all machines.
    """
    folder = folder or new_path(docs.sparkSession, "tokens")
    by_id = F.col("doc_id").asc_nulls_last()
    rows = docs.select(F.col("doc_id").cast("bigint"), "text")
    laid = rows.repartitionByRange(by_id).sortWithinPartitions(by_id, "text")
    return stored(laid.mapInArrow(_write(folder, vocabulary, sequence, parts), _MANIFEST), "manifest")


class TokenFile:
    """Random access to the sequences of a file; nothing is copied where it can be memory-mapped."""

    def __init__(self, path: str) -> None:
        store, name = FileSystem.from_uri(path)
        source = pa.memory_map(name) if store.type_name == "local" else store.open_input_file(name)
        self.reader = ipc.open_file(source)
        self.sequence = self.reader.schema.field("ids").type.list_size
        self.batches = self.reader.num_record_batches
        self.width = self.reader.get_batch(0).num_rows if self.batches else 0

    def ids_of(self, batch: int) -> np.ndarray:
        """The ids of a record batch, one after the other, without the filling."""
        one = self.reader.get_batch(batch)
        ids, mask = one.column("ids").values, one.column("mask").values
        flat = ids.slice(one.column("ids").offset * self.sequence).to_numpy()
        return flat[: mask.true_count]

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of sequence i; the ids are a view of the file."""
        one = self.reader.get_batch(i // self.width)
        at = i % self.width * self.sequence
        ids = one.column("ids").values.slice(at, self.sequence).to_numpy()
        return ids, one.column("mask").values.slice(at, self.sequence).to_numpy(zero_copy_only=False)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, index, base in zip(*(c.to_pylist() for c in batch.columns)):
            yield from _read(path, index, base)


def _read(path: str, index: str, base: int) -> Iterator[pa.RecordBatch]:
    """One row per document of a file, computed from the ids read back."""
    tokens = TokenFile(path)
    have, at, current = np.zeros(0, "<u4"), 0, 0
    store, name = FileSystem.from_uri(index)
    with store.open_input_file(name) as source:
        docs = ipc.open_file(source)
        for i in range(docs.num_record_batches):
            part = docs.get_batch(i)
            sums = []
            for count in part.column("n_tokens").to_pylist():
                crc = 0
                while count:
                    if at == len(have):
                        have, at, current = tokens.ids_of(current).astype("<u4"), 0, current + 1
                    piece = have[at : at + count]
                    crc = zlib.crc32(piece.data, crc)
                    at, count = at + len(piece), count - len(piece)
                sums.append(crc)
            start = pa.array(part.column("first").to_numpy() + base)
            yield pa.record_batch(
                [part.column("doc_id"), start, part.column("n_tokens"), pa.array(sums, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def read_documents(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read from the files.

    ``start`` counts the ids of all documents before it, over all files.
    """
    before = F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    files = manifest.select("path", "index", F.coalesce(before, F.lit(0)).cast("bigint").alias("base"))
    return files.repartition("path").mapInArrow(
        _documents, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    )
