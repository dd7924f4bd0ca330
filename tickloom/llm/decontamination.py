"""Benchmark passages in a corpus, by a positional inverted index (operator 2).

The index is a table of shards. A shard covers some consecutive documents, and holds for each of
their distinct words (terms) the ascending list of places at which it stands, counted through the
shard. Every word of every document is in it. A frequent term is thus cut into as many lists as
there are shards, and no list is ever gathered in one place.

A search takes phrases: sequences of terms. Term counts over the whole index say which terms of a
phrase are rare. In each shard, the list of the rarest term, shifted by its offset in the phrase,
gives the candidate places; they are intersected with the shifted list of the next rarest term, and
so on. With ``slack`` the other terms may stand up to that many words from their place (proximity).

Phrases are searched for in blocks of at most ``BLOCK``; this, not the corpus, is what the driver
sends to all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.shared import stored, text_key, workspace
from tickloom.llm.words import PLAIN, mix, slices, split

#: Bytes of text in a shard, unless one text alone is longer.
SHARD = 2 << 20
#: Phrases sent to the tasks at a time; each has at most ``window`` terms of 8 bytes.
BLOCK = 200_000

_INDEX = (
    "shard bigint, doc_ids array<bigint>, high array<bigint>, low array<bigint>, "
    "first array<int>, terms binary, counts binary, places binary"
)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        for part in slices(batch, "text", SHARD):
            words = split(part.column("text"), PLAIN, fold=True)
            order = np.argsort(words.hash, kind="stable")
            sorted_terms = words.hash[order]
            edge = np.flatnonzero(np.concatenate([[True], sorted_terms[1:] != sorted_terms[:-1]]))
            if not len(order):
                edge = edge[:0]
            counts = np.diff(np.append(edge, len(order))).astype("<i4")
            whole = [[0, part.num_rows]]
            lists = [
                pa.ListArray.from_arrays(pa.array(whole[0], pa.int32()), part.column(c).cast(pa.int64()))
                for c in ("doc_id", "high", "low")
            ]
            yield pa.record_batch(
                [
                    pa.array([number], pa.int64()),
                    *lists,
                    pa.array([words.first.astype(np.int32)], pa.list_(pa.int32())),
                    pa.array([sorted_terms[edge].astype("<u8").tobytes()], pa.binary()),
                    pa.array([counts.tobytes()], pa.binary()),
                    pa.array([order.astype("<i4").tobytes()], pa.binary()),
                ],
                names=["shard", "doc_ids", "high", "low", "first", "terms", "counts", "places"],
            )
            number += 1


def build_index(docs: DataFrame) -> DataFrame:
    """The positional index of ``docs`` (doc_id, text), stored in the shared folder.

    Words are runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased. Null and
    empty texts are in the index without words. Repeated rows are indexed one by one.
    """
    key = text_key(F.col("text"))
    rows = docs.select(F.col("doc_id").cast("bigint"), "text", key.high.alias("high"), key.low.alias("low"))
    return stored(rows.mapInArrow(_shards, _INDEX), "index")


def documents_of(index: DataFrame) -> DataFrame:
    """(shard, at, doc_id, high, low, n_words) of every indexed row, in the order of the shards."""
    zipped = F.arrays_zip("doc_ids", "high", "low")
    one = index.select("shard", "first", F.posexplode(zipped).alias("at", "d"))
    length = F.element_at("first", F.col("at") + 2) - F.element_at("first", F.col("at") + 1)
    return one.select("shard", "at", "d.doc_ids", "d.high", "d.low", length.cast("bigint").alias("n_words")).withColumnRenamed(
        "doc_ids", "doc_id"
    )


def _windows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = split(part.column("text"), PLAIN, fold=True)
                counts = words.counts
                number = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
                item = np.repeat(np.arange(part.num_rows), number)
                inner = np.arange(len(item)) - np.repeat(np.cumsum(number) - number, number)
                start = words.first[:-1][item] + inner
                length = np.minimum(counts[item], size)
                edges = np.concatenate([[0], np.cumsum(length)])
                at = np.repeat(start - edges[:-1], length) + np.arange(edges[-1])
                terms = words.hash[at]
                key = length.astype(np.uint64)
                for k in range(size):
                    own = k < length
                    key[own] = mix(key[own] + terms[edges[:-1][own] + k])
                yield pa.record_batch(
                    [
                        part.column("item_id").take(pa.array(item)),
                        pa.array(key.view(np.int64)),
                        pa.ListArray.from_arrays(
                            pa.array(edges.astype(np.int32)), pa.array(terms.view(np.int64))
                        ),
                    ],
                    names=["item_id", "phrase", "terms"],
                )

    return run


def phrases_of(items: DataFrame, window: int) -> DataFrame:
    """(item_id, phrase, terms): all runs of ``window`` words of the items; a shorter item is one run.

    Null and empty items have none; an item without id is kept under the id null.
    """
    rows = items.select(F.col("item_id").cast("string"), "text")
    return rows.mapInArrow(_windows(window), "item_id string, phrase bigint, terms array<bigint>").distinct()


class _Shard:
    """The lists of one shard."""

    def __init__(self, row: dict) -> None:
        self.terms = np.frombuffer(row["terms"], "<u8")
        counts = np.frombuffer(row["counts"], "<i4")
        places = np.frombuffer(row["places"], "<i4")
        self.first = np.asarray(row["first"], np.int64)
        self.edges = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        self.places = places.astype(np.int64)
        self.keys = (np.repeat(np.arange(len(counts)), counts) << 32) | self.places

    def numbers(self, terms: np.ndarray) -> np.ndarray:
        """Number of each term in this shard, -1 where it has none."""
        if not len(self.terms):
            return np.full(len(terms), -1)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)


class Phrases:
    """A block of phrases: their terms by number, and the order from the rarest to the commonest."""

    def __init__(self, rows: pa.Table, counts: dict[int, int]) -> None:
        self.phrase = rows["phrase"].to_numpy()
        lists = rows["terms"].combine_chunks()
        self.length = lists.value_lengths().to_numpy().astype(np.int64)
        flat = lists.flatten().to_numpy().view(np.uint64)
        self.vocabulary, number = np.unique(flat, return_inverse=True)
        width = int(self.length.max(initial=0))
        owner = np.repeat(np.arange(len(self.length)), self.length)
        offset = np.arange(len(owner)) - np.repeat(np.cumsum(self.length) - self.length, self.length)
        common = np.array([counts.get(int(t), 0) for t in self.vocabulary.view(np.int64)], np.int64)
        order = np.lexsort((offset, common[number], owner))
        rank = offset  # the places within a phrase are the same for ranks
        self.term = np.full((len(self.length), width), -1)
        self.offset = np.zeros((len(self.length), width), np.int64)
        self.term[owner, rank] = number[order]
        self.offset[owner, rank] = offset[order]

    def occurrences(self, shard: _Shard, slack: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, phrase and first place of each occurrence; places are within the document."""
        if not len(self.phrase):
            return (np.zeros(0, np.int64),) * 3
        own = shard.numbers(self.vocabulary)
        term = np.where(self.term >= 0, own[self.term], 0)
        there = np.flatnonzero((term >= 0).all(axis=1))
        rarest = term[there, 0]
        size = shard.edges[rarest + 1] - shard.edges[rarest]
        phrase = np.repeat(there, size)
        at = np.arange(len(phrase)) - np.repeat(np.cumsum(size) - size, size)
        anchor = shard.places[np.repeat(shard.edges[rarest], size) + at]
        doc = np.searchsorted(shard.first, anchor, "right") - 1
        low, high = shard.first[doc], shard.first[doc + 1]
        start = anchor - self.offset[phrase, 0]
        good = (start >= low - slack) & (start + self.length[phrase] <= high + slack)
        phrase, start, doc, low, high = (x[good] for x in (phrase, start, doc, low, high))
        for k in range(1, self.term.shape[1]):
            wanted = self.term[phrase, k] >= 0
            base = start + self.offset[phrase, k]
            least, most = np.maximum(base - slack, low), np.minimum(base + slack, high - 1)
            number = term[phrase, k] << 32
            found = np.searchsorted(shard.keys, number | np.maximum(least, 0))
            hit = shard.keys[np.minimum(found, len(shard.keys) - 1)] if len(shard.keys) else found
            good = ~wanted | ((hit >= (number | np.maximum(least, 0))) & (hit <= (number | np.maximum(most, 0))) & (most >= least))
            phrase, start, doc, low, high = (x[good] for x in (phrase, start, doc, low, high))
        return doc, phrase, start - low


def _count_terms(vocabulary: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                terms = np.frombuffer(batch.column("terms")[row].as_py(), "<u8")
                counts = np.frombuffer(batch.column("counts")[row].as_py(), "<i4")
                if len(terms):
                    at = np.minimum(np.searchsorted(terms, vocabulary), len(terms) - 1)
                    there = terms[at] == vocabulary
                    yield pa.record_batch(
                        [pa.array(vocabulary[there].view(np.int64)), pa.array(counts[at[there]].astype(np.int64))],
                        names=["term", "n"],
                    )

    return run


def _probe(phrases: Phrases, slack: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("terms", "counts", "places", "first")}
                doc, phrase, start = phrases.occurrences(_Shard(row), slack)
                yield pa.record_batch(
                    [
                        pa.array(np.full(len(doc), batch.column("shard")[i].as_py())),
                        pa.array(doc.astype(np.int32)),
                        pa.array(phrases.phrase[phrase]),
                        pa.array(start.astype(np.int64)),
                        pa.array(phrases.length[phrase].astype(np.int32)),
                    ],
                    names=["shard", "at", "phrase", "start", "length"],
                )

    return run


def occurrences(index: DataFrame, phrases: DataFrame, slack: int = 0) -> DataFrame:
    """(shard, at, phrase, start, length): where each phrase (phrase, terms) stands in the index.

    ``start`` counts the words of the document before the phrase. With ``slack`` 0 the words
    follow each other exactly. Otherwise the rarest word fixes the place and the others stand in the
    same document, at most ``slack`` words from where the phrase would have them.
    """
    phrases = stored(phrases.select("phrase", "terms").dropDuplicates(["phrase"]), "phrases")
    blocks = -(-phrases.count() // BLOCK)
    found = None
    for block in range(max(1, blocks)):
        part = phrases.where(F.pmod("phrase", F.lit(max(1, blocks))) == block).orderBy("phrase").toArrow()
        vocabulary = np.unique(part["terms"].combine_chunks().flatten().to_numpy().view(np.uint64))
        counted = index.select("terms", "counts").mapInArrow(_count_terms(vocabulary), "term bigint, n bigint")
        counts = counted.groupBy("term").agg(F.sum("n").alias("n")).toArrow()
        known = dict(zip(counts["term"].to_pylist(), counts["n"].to_pylist()))
        one = index.select("shard", "terms", "counts", "places", "first").mapInArrow(
            _probe(Phrases(part, known), slack),
            "shard bigint, at int, phrase bigint, start bigint, length int",
        )
        found = one if found is None else found.unionByName(one)
    return stored(found, "occurrences")


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, slack: int = 0) -> DataFrame:
    """What each row of ``docs`` shares with the benchmark ``items`` (item_id, text).

    One row per row of ``docs``: doc_id, high and low (a key of the text), n_words, n_hit (words
    inside an occurrence of a window), n_items (items of which a window occurs), items (their
    ids, sorted as strings), contaminated. Items without id count as one item, listed as an empty
    string; of items that share an id, all windows count. Empty tables give no rows or no hits.
    """
    with workspace(docs.sparkSession):
        return stored(_contamination(docs, items, window, slack), "contamination", keep=True)


def _contamination(docs: DataFrame, items: DataFrame, window: int, slack: int) -> DataFrame:
    index = build_index(docs.select("doc_id", "text"))
    phrases = stored(phrases_of(items.select("item_id", "text"), window), "windows")
    found = occurrences(index, phrases, slack)
    order = Window.partitionBy("shard", "at").orderBy("start", "length")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = found.select("shard", "at", "start", "length").distinct().withColumn("end", F.col("start") + F.col("length"))
    hit = spans.withColumn(
        "fresh", F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(before, F.lit(0))))
    ).groupBy("shard", "at").agg(F.sum("fresh").cast("bigint").alias("n_hit"))  # with slack, as if in place
    owners = phrases.select("phrase", F.coalesce("item_id", F.lit("")).alias("item_id"))
    named = (
        found.select("shard", "at", "phrase")
        .distinct()
        .join(owners, "phrase")
        .groupBy("shard", "at")
        .agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    )
    nothing = F.array().cast("array<string>")
    return (
        documents_of(index)
        .join(hit, ["shard", "at"], "left")
        .join(named, ["shard", "at"], "left")
        .select(
            "doc_id",
            "high",
            "low",
            "n_words",
            F.least("n_words", F.coalesce("n_hit", F.lit(0).cast("bigint"))).alias("n_hit"),
            F.coalesce(F.size(F.coalesce("items", nothing)), F.lit(0)).cast("bigint").alias("n_items"),
            F.coalesce("items", nothing).alias("items"),
            F.col("n_hit").isNotNull().alias("contaminated"),
        )
    )
