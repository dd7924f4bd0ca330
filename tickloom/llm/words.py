"""Words of many texts at once: numpy over the bytes of an Arrow column.

Two word rules are used. ``BLANK`` ends words at ASCII white space (space, \\t to \\r), ``PLAIN``
at every ASCII byte that is neither a letter nor a digit. Other bytes of UTF-8 belong to words
in both. ``fold`` lower-cases A to Z and nothing else.

A word is known by a 64-bit hash: the sum of byte codes times growing powers of an odd number,
mixed with the length. Everything else (shingles, windows) is put together from word hashes,
so equal texts always have equal hashes, and different ones differ but for chances near 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at a time, unless one text alone is longer.
CHUNK = 2 << 20
#: Bytes hashed at a time, unless one word alone is longer.
HASHED = 1 << 18

_ALL = np.arange(256)
BLANK = ~((_ALL == 0x20) | ((_ALL >= 0x09) & (_ALL <= 0x0D)))
PLAIN = (
    (_ALL >= 0x80)
    | ((_ALL >= 0x30) & (_ALL <= 0x39))
    | ((_ALL >= 0x41) & (_ALL <= 0x5A))
    | ((_ALL >= 0x61) & (_ALL <= 0x7A))
)
_FOLD = _ALL.copy()
_FOLD[0x41:0x5B] += 0x20
FOLD = _FOLD.astype(np.uint8)

_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed one-to-one scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_CODES = mix((_ALL.astype(np.uint64) + np.uint64(1)) * _BASE)


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """_STEP to the power of 0, 1, 2 ... and of 0, -1, -2 ..., modulo 2**64."""
    back = np.uint64(pow(int(_STEP), -1, 1 << 64))
    out = []
    for factor in (_STEP, back):
        row = np.full(size, factor, np.uint64)
        row[0] = 1
        out.append(np.multiply.accumulate(row))
    return out[0], out[1]


class Words(NamedTuple):
    """Words of several texts. Text i has the words first[i] to first[i + 1]."""

    data: np.ndarray  # bytes of the texts, one after the other (folded where asked)
    edges: np.ndarray  # where each text begins in data, and the end
    start: np.ndarray  # of each word, in data
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column, and where each text begins in them."""
    if texts.null_count:
        texts = pc.fill_null(texts, "" if not pa.types.is_binary(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    edges = np.frombuffer(offsets, np.int64 if wide else np.int32)
    edges = edges[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[edges[0] : edges[-1]], edges - edges[0]


def split(texts: pa.Array, kind: np.ndarray = BLANK, fold: bool = False) -> Words:
    """The words of each text; null and empty texts have none."""
    data, edges = _bytes(texts)
    if fold:
        data = FOLD[data]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = kind[data]
    change = inside[1:] != inside[:-1]
    # a word also ends where its text does
    inner = edges[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    inner = np.unique(inner[inside[inner] & inside[inner + 1]])
    flips = np.flatnonzero(change)
    if len(inner):
        flips = np.sort(np.concatenate([flips, inner, inner]))
    start, end = flips[0::2], flips[1::2]
    first = np.searchsorted(start, edges).astype(np.int64)
    return Words(data, edges, start, end, first, _hashes(data, start, end))


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the words, for some bytes at a time; a longer word takes what it needs."""
    out = np.zeros(len(start), np.uint64)
    at = 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(end, start[at] + HASHED, "right")))
        low, high = start[at], end[to - 1]
        up, down = _powers(max(HASHED, 1 << int(high - low).bit_length()))
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(_CODES[data[low:high]] * up[: high - low], out=sums[1:])
        s, e = start[at:to] - low, end[at:to] - low
        out[at:to] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        at = to
    return out


def slices(
    batch: pa.RecordBatch, column: str, limit: int = CHUNK, rows: int | None = None
) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``limit`` bytes of text and at most ``rows`` texts; a longer text comes alone."""
    if not batch.num_rows:
        return
    _, edges = _bytes(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(edges, edges[at] + limit, "right")) - 1)
        to = min(to, at + (rows or to))
        yield batch.slice(at, to - at)
        at = to


def grams(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each ``size`` consecutive words of a text, and where each text begins in them.

    A text with fewer words, but not none, counts as one sequence.
    """
    hashes, first, counts = words.hash, words.first, words.counts
    out = np.zeros(len(hashes), np.uint64)
    for k in range(size):
        ahead = hashes[k:]
        out[: len(ahead)] = out[: len(ahead)] * _STEP + ahead
    number = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    edges = np.concatenate([[0], np.cumsum(number)]).astype(np.int64)
    text = np.repeat(np.arange(len(counts)), number)
    at = np.arange(edges[-1]) - edges[:-1][text] + first[:-1][text]
    result = out[at]
    for k in range(1, size):  # texts with k words only: the sum stops at their end
        few = np.flatnonzero(counts == k)
        whole = np.zeros(len(few), np.uint64)
        for j in range(k):
            whole = whole * _STEP + hashes[first[few] + j]
        result[edges[few]] = whole + np.uint64(k)
    return mix(result), edges
