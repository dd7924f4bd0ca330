"""Tokens of two vocabularies matched by the bytes they stand for (operator 13).

Both encodings of a text cover the same bytes. Every token points to the token of the other side that overlaps it and
ends farthest to the right; where both end at the same byte, the token of side A points to that of side B, which
points to itself. Doubling the pointers leads every token to the last one of its group, which names the group.

A text is cut into units before each space that follows something else, as no token of either side goes on there.
Units repeat, so a part of the corpus (up to ``PART`` bytes of text) is encoded and matched once for each different unit
and a text is a list of units. Pairs of ids are counted per part first, then summed by Spark, and the counts go
back to the parts that hold the pair. A part's own numbers of units are sums over its pairs, a text's over its units.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.shared import stored, workspace
from tickloom.llm.words import _bytes, _hashes, slices

PART = 4 << 20
#: Fixed value: how a byte-level vocabulary cuts a text before it merges.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Kinds of stored rows: a text with its units, the links of a part's units, a pair of ids of a part.
TEXT, UNITS, PAIR = 0, 1, 2
_STORED = (
    "part bigint, kind int, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
    "data binary, number int, a int, b int, docs bigint"
)
_NAMES = [column.split()[0] for column in _STORED.split(", ")]
_RESULT = (
    "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, "
    "groups_sha256 string"
)


class Side:
    """A vocabulary: the bytes of its ids, one after the other, and how to encode units."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.first = np.cumsum(self.length) - self.length
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def lists(self, units: list[str]) -> list[list[int]]:
        raise NotImplementedError

    def encode(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the units, one after the other, and how many belong to each."""
        found = self.lists(units)
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.int64, int(counts.sum())), counts

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        return self.data[spread(self.first[ids], self.length[ids])]


def byte_of_letter() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones for themselves, the others
    for the letters from 256 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteLevel(Side):
    """A byte-level vocabulary in a tokenizers file whose merges come in the order of their ids."""

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        letters = byte_of_letter()
        tokens: dict[int, bytes] = {}
        special = {t["id"] for t in content.get("added_tokens", ())}
        for text, i in content["model"]["vocab"].items():
            tokens[i] = text.encode() if i in special else bytes(letters[c] for c in text)
        super().__init__([tokens.get(i, b"") for i in range(max(tokens) + 1)])
        ranks = {tokens[i]: i for i in tokens if i not in special}
        self.encoding = tiktoken.Encoding(path, pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})

    def lists(self, units: list[str]) -> list[list[int]]:
        return [self.encoding.encode_ordinary(u) for u in units]


class Pieces(Side):
    """A sentencepiece vocabulary that puts a space before a text."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        tokens = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            tokens.append(bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode())
        super().__init__(tokens)
        self.space = [self.model.piece_to_id("▁")]

    def lists(self, units: list[str]) -> list[list[int]]:
        found = self.model.encode([u[1:] for u in units], num_threads=1)
        return [ids or self.space for ids in found]


@lru_cache(maxsize=2)
def byte_level(path: str) -> ByteLevel:
    return ByteLevel(path)


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def spread(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... up to length[0] numbers, then from first[1] on, and so forth."""
    edges = np.cumsum(length)
    return np.repeat(first - (edges - length), length) + np.arange(edges[-1] if len(edges) else 0)


def distinct(numbers: np.ndarray) -> np.ndarray:
    """The different ones of some numbers, in order; faster than numpy's own way here."""
    numbers = np.sort(numbers)
    return numbers[np.append(True, numbers[1:] != numbers[:-1])] if len(numbers) else numbers


def squeeze(numbers: np.ndarray) -> bytes:
    """Small whole numbers as compressed bytes: all low bytes, then all second bytes, and so on."""
    return zstandard.compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unsqueeze(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def groups(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each token of both sides, from where the tokens end; groups are numbered from 0, left to right.

    Both sides cover the same bytes without gaps.
    """
    n = len(a_end)
    to_b = np.searchsorted(b_end, a_end)  # holds the last byte of the token
    to_a = np.searchsorted(a_end, b_end)
    own = np.arange(len(b_end))
    farther = a_end[np.minimum(to_a, max(n - 1, 0))] > b_end if n else np.zeros(0, bool)
    follow = np.concatenate([to_b + n, np.where(farther, to_a, own + n)])
    while True:
        twice = follow[follow]
        if (twice == follow).all():
            break
        follow = twice
    number = np.cumsum(follow[n:] == own + n) - 1  # of the group whose last token this is
    group = number[follow - n]
    return group[:n], group[n:]


def _units(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of space + text for each text that is not empty, where the units begin and end, and the text of each."""
    texts = pc.fill_null(texts, "")
    data, edges = _bytes(pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(" ", texts, "")))
    back = [np.concatenate([np.zeros(k, np.uint8), data[: max(len(data) - k, 0)]])[: len(data)] for k in (1, 2, 3)]
    blank = ((back[0] >= 9) & (back[0] <= 13)) | ((back[0] >= 28) & (back[0] <= 32))
    # white space beyond ASCII, and some other signs; a cut less does no harm
    blank |= (back[1] == 0xC2) & ((back[0] == 0x85) | (back[0] == 0xA0))
    blank |= (back[2] >= 0xE1) & (back[2] <= 0xE3) & ((back[1] == 0x80) | (back[1] == 0x81) | (back[1] == 0x9A))
    cut = (data == 0x20) & ~blank
    cut[edges[:-1][np.diff(edges) > 0]] = True
    start = np.flatnonzero(cut)
    end = np.append(start[1:], len(data))
    return data, start, end, np.searchsorted(edges, start, "right") - 1


class Matched:
    """The different units of some texts, encoded and matched."""

    def __init__(self, texts: pa.Array, one: Side, two: Side) -> None:
        data, start, end, self.text = _units(texts)
        _, at, self.unit = np.unique(_hashes(data, start, end), return_index=True, return_inverse=True)
        size = (end - start)[at]
        raw = data[spread(start[at], size)]
        edges = np.append(0, np.cumsum(size))
        whole = raw.tobytes()
        units = [whole[s:e].decode() for s, e in zip(edges[:-1].tolist(), edges[1:].tolist())]
        (a, a_count), (b, b_count) = one.encode(units), two.encode(units)
        covers = self._covers(one, a, a_count, raw, edges) & self._covers(two, b, b_count, raw, edges)
        # texts with a unit that one of the sides changes have no tokens
        self.void = np.zeros(len(texts), bool)
        self.void[self.text[~covers[self.unit]]] = True
        keep = ~self.void[self.text]
        self.text, self.unit = self.text[keep], self.unit[keep]
        a, b = a[np.repeat(covers, a_count)], b[np.repeat(covers, b_count)]
        self.a_count, self.b_count = np.where(covers, a_count, 0), np.where(covers, b_count, 0)
        self._match(a, b, one, two)

    @staticmethod
    def _covers(side: Side, ids: np.ndarray, counts: np.ndarray, raw: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Which units the joined bytes of their ids give again."""
        total = np.append(0, np.cumsum(side.length[ids]))
        ends = np.append(0, np.cumsum(counts))
        good = np.diff(total[ends]) == np.diff(edges)
        if good.all():
            differ = np.append(0, np.cumsum(side.bytes_of(ids) != raw))
            return np.diff(differ[edges]) == 0
        joined = side.bytes_of(ids)
        same = [good[u] and (joined[total[ends[u]] : total[ends[u + 1]]] == raw[edges[u] : edges[u + 1]]).all() for u in range(len(counts))]
        return np.array(same, bool)

    def _match(self, a: np.ndarray, b: np.ndarray, one: Side, two: Side) -> None:
        a_end, b_end = np.cumsum(one.length[a]), np.cumsum(two.length[b])
        a_group, b_group = groups(a_end, b_end)
        units = len(self.a_count)
        a_unit, b_unit = np.repeat(np.arange(units), self.a_count), np.repeat(np.arange(units), self.b_count)
        # a link for each stretch between two ends, of the tokens that hold it
        ends = distinct(np.concatenate([a_end, b_end]))
        in_a = np.searchsorted(a_end, ends)
        self.link_unit = a_unit[in_a]
        self.link = a[in_a] << 32 | b[np.searchsorted(b_end, ends)]
        self.links = np.bincount(self.link_unit, minlength=units)
        last = np.append(b_group[1:] != b_group[:-1], True) if len(b) else np.zeros(0, bool)
        self.groups = np.bincount(b_unit[last], minlength=units)
        self._write(a, b, a_group, b_group, last, b_unit)

    def _write(self, a, b, a_group, b_group, last, b_unit) -> None:
        """The text of the groups of each unit, each group closed by a semicolon."""
        order = np.argsort(np.concatenate([2 * a_group, 2 * b_group + 1]), kind="stable")
        ids = np.concatenate([a, b])[order]
        closing = np.append(a_group[1:] != a_group[:-1], True) if len(a) else last
        sign = np.concatenate([np.where(closing, ord("|"), ord(",")), np.where(last, ord(";"), ord(","))])[order]
        digits = np.searchsorted([10, 100, 1_000, 10_000, 100_000, 1_000_000], ids, "right") + 1
        edges = np.append(0, np.cumsum(digits + 1))
        out = np.zeros(edges[-1], np.uint8)
        out[edges[1:] - 1] = sign
        rest, place = ids.copy(), edges[1:] - 2
        for k in range(int(digits.max(initial=0))):
            own = digits > k
            out[place[own] - k] = 48 + rest[own] % 10
            rest //= 10
        unit = np.concatenate([np.repeat(np.arange(len(self.a_count)), self.a_count), b_unit])[order]
        size = np.bincount(unit, weights=digits + 1, minlength=len(self.a_count)).astype(np.int64)
        to = np.cumsum(size)
        data = out.tobytes()
        self.written = [data[e - s : e] for s, e in zip(size.tolist(), to.tolist())]

    def digest(self, units: np.ndarray) -> str:
        if not len(units):
            return ""
        return hashlib.sha256(b"".join([self.written[u] for u in units.tolist()])[:-1]).hexdigest()

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of ids, how many texts hold each, and the number of the pair of each link, unit by unit."""
        pair, number = np.unique(self.link, return_inverse=True)
        units, many = len(self.a_count), max(len(pair), 1)
        # different pairs of each unit, then of each text
        own = distinct(self.link_unit.astype(np.int64) * many + number)
        of_unit = np.bincount(own // many, minlength=units)
        first = np.cumsum(of_unit) - of_unit
        held = distinct(self.text.astype(np.int64) * max(units, 1) + self.unit)
        text, unit = np.divmod(held, max(units, 1))
        found = own[spread(first[unit], of_unit[unit])] % many
        found = distinct(np.repeat(text, of_unit[unit]) * many + found) % many
        return pair, np.bincount(found, minlength=len(pair)), number


def _match_parts(first: str, second: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two, part = byte_level(first), pieces(second), TaskContext.get().partitionId() << 32
        for batch in batches:
            for rows in slices(batch, "text", PART):
                yield from _rows(Matched(rows.column("text"), one, two), rows.column("doc_id"), part)
                part += 1

    return run


def _batch(rows: int, **columns: object) -> pa.RecordBatch:
    """Rows as they are stored, null where nothing is given."""
    kinds = {"string": pa.string(), "binary": pa.binary(), "int": pa.int32(), "bigint": pa.int64()}
    made = []
    for name, kind in (column.split() for column in _STORED.split(", ")):
        value = columns.get(name)
        if isinstance(value, int):
            value = np.full(rows, value)
        made.append(pa.nulls(rows, kinds[kind]) if value is None else pa.array(value, kinds[kind]))
    return pa.record_batch(made, names=_NAMES)


def _rows(found: Matched, doc_ids: pa.Array, part: int) -> Iterator[pa.RecordBatch]:
    """One row per text with its units, one with the links of all units, one per pair of ids."""
    docs = len(doc_ids)
    edges = np.searchsorted(found.text, np.arange(docs + 1))
    n_a, n_b, n_groups, n_links = (
        np.bincount(found.text, weights=x[found.unit], minlength=docs).astype(np.int64)
        for x in (found.a_count, found.b_count, found.groups, found.links)
    )
    digests, held = [], []
    for s, e in zip(edges[:-1], edges[1:]):
        digests.append(found.digest(found.unit[s:e]))
        held.append(squeeze(np.diff(np.sort(found.unit[s:e]), prepend=0)))
    yield _batch(
        docs, part=part, kind=TEXT, doc_id=doc_ids, n_a=n_a, n_b=n_b, n_groups=n_groups, n_links=n_links,
        groups_sha256=digests, data=held,
    )
    pair, count, number = found.pairs()
    links = squeeze(np.concatenate([[len(found.links)], found.links, number]))
    yield _batch(1, part=part, kind=UNITS, data=[links])
    yield _batch(
        len(pair), part=part, kind=PAIR, number=np.arange(len(pair)), a=pair >> 32, b=pair & 0xFFFFFFFF, docs=count
    )


def _numbers(rows: pa.Table, pairs: pa.Table) -> pa.Table:
    """The texts of a part with the sums over their links."""
    kind = rows["kind"].to_numpy()
    docs = rows.filter(pa.array(kind == TEXT))
    links = unsqueeze(rows["data"][int(np.flatnonzero(kind == UNITS)[0])].as_py())
    units, links = links[0], links[1:]
    unit, number = np.repeat(np.arange(units), links[:units]), links[units:]
    values = np.zeros((2, len(pairs)), np.int64)
    values[0, pairs["number"].to_numpy()] = pairs["best"].to_numpy()
    values[1, pairs["number"].to_numpy()] = pairs["count"].to_numpy()
    of_unit = np.zeros((2, units), np.int64)
    for row, value in zip(of_unit, values):
        np.add.at(row, unit, value[number])
    held = [np.cumsum(unsqueeze(data)) for data in docs["data"].to_pylist()]
    sums = np.array([of_unit[:, own].sum(axis=1) for own in held], np.int64).reshape(-1, 2)
    kept = docs.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
    kept = kept.append_column("n_best", pa.array(sums[:, 0])).append_column("count_sum", pa.array(sums[:, 1]))
    return kept.append_column("groups_sha256", docs["groups_sha256"])


def align(docs: DataFrame, first: str, second: str) -> DataFrame:
    """How the tokens of two vocabularies cover each text of ``docs`` (doc_id, text); one row for each of its rows.

    ``first`` is the path of a byte-level tokenizers file (side A, which encodes a space and the text), ``second`` that of
    a sentencepiece model (side B); both are the same on all machines. Returns doc_id, n_a and n_b tokens, n_groups
    between bytes at which tokens of both sides end, n_links (pairs of tokens that overlap), n_best (links whose pair of
    ids stands in as many documents as any pair of that A id), count_sum (over the links, in how many documents
    their pair stands), and groups_sha256 (of the ids, ``a1,a2|b1;a3|b2,b3``).

    Texts that are null, empty or changed by a side have zeros and an empty string and count nowhere. Each row is a document, also
    repeated ones and those without doc_id. An empty table has no rows. A very long text is a part by itself and takes
    some 150 bytes of memory a byte.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    with workspace(docs.sparkSession):
        parts = stored(rows.mapInArrow(_match_parts(first, second), _STORED), "matched", keep=True)
    pairs = parts.where(F.col("kind") == PAIR).select("part", "number", "a", "b", "docs")
    totals = pairs.groupBy("a", "b").agg(F.sum("docs").alias("count"))
    most = totals.groupBy(F.col("a").alias("of")).agg(F.max("count").alias("most"))
    totals = totals.join(most, F.col("a") == F.col("of")).select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))
    known = pairs.join(totals, ["a", "b"]).select(F.col("part").alias("of_part"), "number", "count", F.col("best").cast("int").alias("best"))
    texts = parts.where(F.col("kind") != PAIR).drop("number", "a", "b", "docs")
    return texts.groupBy("part").cogroup(known.groupBy("of_part")).applyInArrow(_numbers, _RESULT)
