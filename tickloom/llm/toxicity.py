"""Toxicity scores by FTRL-proximal logistic regression (operator 8).

A text is the set of its hashed words, pairs of neighbours and pairs with one word between. The
hash has 31 bits, so features hardly ever share a weight; only those that occur in ``SEEN`` texts
are learned. Each coordinate has a learning rate of its own, which falls with the
gradients it has seen, and the L1 term leaves all but a few hundred weights at zero. These go to
the executors with the scoring function.

The features of the labelled texts are made by all tasks. Learning is sequential by nature, so one task goes
through them, ``PASSES`` times, in an order given by hashes. What it sees is bounded by a parameter: at most
``SAMPLE`` labelled texts, those of the given documents with the smallest hashes of their doc_id. Averaging the weights of
several tasks was tried and found much worse (8 shards: 60 % of held-out toxic texts found, one: 99 %).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tickloom.llm.shared import stored, workspace
from tickloom.llm.words import PLAIN, Words, mix, slices, split

SAMPLE = 12_000
PASSES = 3
SEEN = 4
ALPHA, BETA, L1, L2 = 2.0, 1.0, 6.0, 0.1
#: From this score on a text counts as toxic.
TOXIC = 0.3


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from; a row without doc_id is not held out, nor labelled."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Text number and feature of every word, neighbouring pair and pair with a gap."""
    text = np.repeat(np.arange(len(words.counts)), words.counts)
    found, owner = [words.hash], [text]
    for gap, factor in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F)):
        same = text[gap:] == text[:-gap]
        pair = words.hash[:-gap] * np.uint64(factor) + words.hash[gap:]
        found.append(mix(pair[same]))
        owner.append(text[gap:][same])
    return np.concatenate(owner), (np.concatenate(found) >> np.uint64(33)).astype(np.int32)


def _feature_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", 1 << 19):
            owner, found = features(split(part.column("text"), PLAIN, fold=True))
            keys = np.unique(owner.astype(np.int64) << 32 | found)
            count = np.bincount(keys >> 32, minlength=part.num_rows)
            edges = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
            sets = pa.ListArray.from_arrays(
                pa.array(edges), pa.array((keys & 0x7FFFFFFF).astype(np.int32))
            )
            yield pa.record_batch(
                [part.column("place"), part.column("toxic"), sets],
                names=["place", "toxic", "features"],
            )


def _weights(z, n, l1: float):
    return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def _frequent(features: np.ndarray) -> np.ndarray:
    """The features that occur in ``SEEN`` texts at least, in order."""
    ordered = np.sort(features)
    # the first of each that has so many behind it
    last = SEEN - 1
    if len(ordered) <= last:
        return ordered[:0]
    often = ordered[: len(ordered) - last] == ordered[last:]
    often[1:] &= ordered[1 : len(often)] != ordered[: len(often) - 1]
    return ordered[: len(often)][often]


def _learn(table: pa.Table) -> pa.Table:
    """The weights after all passes, by feature; the constant term stands under -1.

    For each coordinate, z sums the gradients, shifted so that the weight follows from it in closed
    form, and n their squares.
    """
    table = table.sort_by([("place", "ascending"), ("toxic", "ascending")])
    if len(table["toxic"].unique()) < 2:  # one kind alone does not tell what sets it apart
        return pa.table({"feature": pa.array([], pa.int32()), "weight": pa.array([], pa.float64())})
    sets = table["features"].combine_chunks()
    flat = sets.flatten().to_numpy()
    own = _frequent(flat)
    edges = np.concatenate([[0], np.cumsum(sets.value_lengths().to_numpy())])
    texts = []
    for start, end in zip(edges[:-1], edges[1:]):
        at = np.minimum(np.searchsorted(own, flat[start:end]), max(len(own) - 1, 0))
        texts.append(at[own[at] == flat[start:end]].astype(np.int32) if len(own) else at[:0])
    z, n = np.zeros(len(own)), np.zeros(len(own))
    bz = bn = 0.0
    for _ in range(PASSES):
        for at, label in zip(texts, table["toxic"].to_pylist()):
            w, bias = _weights(z[at], n[at], L1), float(_weights(bz, bn, 0.0))
            gradient = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35))) - label
            square = gradient * gradient
            z[at] += gradient - (np.sqrt(n[at] + square) - np.sqrt(n[at])) / ALPHA * w
            n[at] += square
            bz += gradient - (np.sqrt(bn + square) - np.sqrt(bn)) / ALPHA * bias
            bn += square
    weight = _weights(z, n, L1)
    kept = weight != 0
    return pa.table(
        {
            "feature": np.append(own[kept], -1).astype(np.int32),
            "weight": np.append(weight[kept], float(_weights(bz, bn, 0.0))),
        }
    )


@dataclass
class ToxicityModel:
    """The weights that are not zero, by ascending feature, and the constant term.

    A model that learned nothing, because labels of one kind or both were missing, holds no text for toxic.
    """

    feature: np.ndarray
    weight: np.ndarray
    bias: float
    learned: bool = True

    def __post_init__(self) -> None:
        self._maybe = np.zeros(1 << 16, bool)
        self._maybe[self.feature & 0xFFFF] = True

    def score(self, texts: pa.Array) -> np.ndarray:
        owner, found = features(split(texts, PLAIN, fold=True))
        likely = self._maybe[found & 0xFFFF]
        keys = np.unique(owner[likely].astype(np.int64) << 32 | found[likely])
        owner, found = keys >> 32, (keys & 0x7FFFFFFF).astype(np.int32)
        total = np.full(len(texts), self.bias)
        if len(self.feature):
            at = np.minimum(np.searchsorted(self.feature, found), len(self.feature) - 1)
            hit = self.feature[at] == found
            np.add.at(total, owner[hit], self.weight[at[hit]])
        return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def train(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Learn from the texts of ``docs`` (doc_id, text) that ``labels`` (doc_id, toxic) marks.

    Held-out rows, null labels and null doc_ids teach nothing, nor do labels of other documents, however many
    these are. Of several labels for a doc_id the highest counts; of several texts under one doc_id one is an example,
    chosen by a hash. A null text has no features. Unless there are labels of both kinds nothing is learned.
    """
    marked = (
        labels.where("toxic is not null and doc_id is not null")
        .where(~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").cast("bigint").alias("marked"))
        .agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        .withColumn("place", F.xxhash64("marked"))
    )
    texts = docs.select(F.col("doc_id").cast("bigint").alias("marked"), "text").where("marked is not null")
    given = marked.join(texts.select("marked"), "marked", "left_semi")
    with workspace(docs.sparkSession):
        sample = stored(given.orderBy("place", "marked").limit(SAMPLE), "toxic-sample")
        rows = texts.join(F.broadcast(sample), "marked")  # at most SAMPLE rows of three numbers
        order = F.struct(F.col("text").isNull(), F.xxhash64("text"), "text")
        rows = rows.groupBy("marked", "place", "toxic").agg(F.min_by("text", order).alias("text"))
        sets = rows.select("place", "toxic", "text").mapInArrow(_feature_sets, "place bigint, toxic int, features array<int>")
        sets = stored(sets, "toxic-sets")
        # the weights that are not zero, of at most SAMPLE texts
        found = sets.groupBy().applyInArrow(_learn, "feature int, weight double").toArrow().sort_by("feature")
    feature, weight = (found[c].to_numpy() for c in ("feature", "weight"))
    if not len(feature):
        return ToxicityModel(feature, weight, -35.0, learned=False)
    return ToxicityModel(feature[1:], weight[1:], float(weight[0]))


def score(docs: DataFrame, model: ToxicityModel, column: str) -> DataFrame:
    """``docs`` with the score of its ``text`` in a new last column. Null texts score as empty ones."""
    if column in docs.columns:
        raise ValueError(f"there is a column {column} already")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                scores = pa.array(model.score(part.column("text")))
                yield pa.RecordBatch.from_arrays([*part.columns, scores], names=[*part.schema.names, column])

    schema = StructType([*docs.schema.fields, StructField(column, DoubleType())])
    return docs.mapInArrow(run, schema)
