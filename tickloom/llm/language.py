"""Language of texts by error-correcting output codes (operator 7).

A text is the counts of its runs of one to three bytes (A-Z lower-cased), hashed to ``BUCKETS``. Each
language has a codeword. For each bit, a binary classifier tells the languages whose codeword has it
from the others: the logarithm of how much more frequent a run is in the one group than in the other
(naive Bayes). The classifiers follow from the mean frequencies of each language, which Spark sums
over all labelled texts, without a sample.

A text's margins are decoded by loss: the codeword with the smallest sum of logistic losses wins.
Where the second is nearly as good, the text is flagged as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.toxicity import held_out
from tickloom.llm.words import FOLD, _bytes, slices

BUCKETS = 8192
#: Bytes of text and texts worked on at a time; a text takes a row of ``BUCKETS`` counts.
PART, ROWS = 1 << 19, 256
#: A lead in loss below this is ambiguous.
CLOSE = 1.0
#: Up to so many languages the code has every way to part them in two.
EVERY = 6
UNKNOWN = "und"


def run_counts(texts: pa.Array) -> np.ndarray:
    """Counts of hashed byte runs, one row per text."""
    data, edges = _bytes(texts)
    code = FOLD[data].astype(np.uint32)
    text = np.repeat(np.arange(len(texts)), np.diff(edges))
    total = np.zeros(len(texts) * BUCKETS, np.int64)
    key = np.zeros(len(code), np.uint32)
    for size in (1, 2, 3):
        # the run of ``size`` bytes that ends at each byte
        key = key << np.uint32(8)
        if size > 1:
            key[1:] = key[:-1].copy()
        key = (key & np.uint32(0xFFFFFF)) | code
        inside = np.ones(len(code), bool)
        inside[: size - 1] = False
        inside[size - 1 :] = text[size - 1 :] == text[: len(text) - size + 1]
        hashed = ((key + np.uint32(size << 24)) * np.uint32(2654435761)) >> np.uint32(19)
        total += np.bincount(text[inside] * BUCKETS + hashed[inside], minlength=len(total))
    return total.reshape(len(texts), BUCKETS)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the relative frequencies by language, one row per language and bucket."""
    total: dict[str, np.ndarray] = {}
    texts: dict[str, int] = {}
    for batch in batches:
        for part in slices(batch, "text", PART, ROWS):
            counts = run_counts(part.column("text"))
            share = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
            langs = np.array(part.column("lang").to_pylist(), object)
            for lang in set(langs):
                total[lang] = total.get(lang, 0) + share[langs == lang].sum(axis=0)
                texts[lang] = texts.get(lang, 0) + int((langs == lang).sum())
    for lang, row in total.items():
        at = np.flatnonzero(row)
        yield pa.record_batch(
            [
                pa.array([lang] * (len(at) + 1), pa.string()),
                pa.array(np.append(at, -1).astype(np.int32)),
                pa.array(np.append(row[at], texts[lang])),
            ],
            names=["lang", "bucket", "total"],
        )


def codewords(languages: int) -> np.ndarray:
    """One row of bits per language. Rows differ in half of the bits or nearly so.

    Few languages get every way to part them in two, more of them the best of some fixed random codes
    with ten bits for each doubling.
    """
    if languages < 2:
        return np.zeros((languages, 0), np.int8)
    if languages <= EVERY:
        ways = range(1, 1 << (languages - 1))
        columns = [[0, *(way >> i & 1 for i in range(languages - 1))] for way in ways]
        return np.array(columns, np.int8).T
    bits = 10 * (languages - 1).bit_length()
    best, widest = None, -1
    for seed in range(32):
        code = np.random.default_rng(seed).integers(0, 2, (languages, bits), np.int8)
        apart = (code[:, None, :] != code[None, :, :]).sum(axis=2) + bits * np.eye(languages, dtype=int)
        if apart.min() > widest:
            best, widest = code, apart.min()
    return best


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray  # language x bit
    weight: np.ndarray  # bucket x bit

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of the language, its share of the likelihood, and whether it is ambiguous."""
        counts = run_counts(texts)
        n = counts.sum(axis=1, keepdims=True)
        margin = counts.astype(np.float32) @ self.weight.astype(np.float32) / np.sqrt(n + 1)
        sign = self.code.astype(np.float64) * 2 - 1
        # sum of log(1 + exp(-margin * sign)) over the bits
        loss = np.stack([np.logaddexp(0, -margin * row).sum(axis=1) for row in sign], axis=1)
        order = np.sort(loss, axis=1)
        share = 1 / np.exp(np.clip(order[:, :1] - loss, -700, 0)).sum(axis=1)
        close = order[:, 1] - order[:, 0] < CLOSE if loss.shape[1] > 1 else np.zeros(len(loss), bool)
        return loss.argmin(axis=1), share, close


def train(docs: DataFrame) -> LanguageModel:
    """Learn from the rows of ``docs`` (doc_id, text, lang) that have a lang and a text and are not held out.

    Repeated rows count as often as they stand there; an empty table teaches nothing.
    """
    rows = docs.where("lang is not null and text is not null").where(~held_out(F.col("doc_id")))
    sums = rows.select("text", "lang").mapInArrow(_sums, "lang string, bucket int, total double")
    # one number per language and bucket
    sums = sums.groupBy("lang", "bucket").agg(F.sum("total").alias("total")).toArrow()
    langs, buckets, totals = (sums[c].to_numpy() for c in ("lang", "bucket", "total"))
    names = sorted(set(langs))
    number = np.searchsorted(np.array(names, object), langs) if names else np.zeros(0, int)
    table = np.zeros((len(names), BUCKETS + 1))
    table[number, buckets] = totals
    frequency = table[:, :-1] / np.maximum(table[:, -1:], 1) + 1e-6
    code = codewords(len(names))
    bits = [np.log(frequency[c == 1].mean(axis=0)) - np.log(frequency[c == 0].mean(axis=0)) for c in code.T]
    weight = np.stack(bits, axis=1) if bits else np.zeros((BUCKETS, 0))
    return LanguageModel(names, code, weight)


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, lang_pred, score, ambiguous) of each row of ``docs`` (doc_id, text).

    A text that is null or has no letter is ``und`` with score 0 and ambiguous, and so is every
    text if nothing was learned. Repeated rows are all returned, an empty table gives no rows. The score is the share of the winner in the likelihood that the losses stand for.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.languages, UNKNOWN], object)
        for batch in batches:
            for part in slices(batch, "text", PART, ROWS):
                known = part.column("letters").to_numpy(zero_copy_only=False).astype(bool)
                best = np.full(part.num_rows, len(model.languages))
                share, close = np.zeros(part.num_rows), np.ones(part.num_rows, bool)
                if model.languages:
                    found, shares, closes = model.predict(part.column("text"))
                    best[known], share[known], close[known] = found[known], shares[known], closes[known]
                yield pa.record_batch(
                    [part.column("doc_id"), pa.array(names[best], pa.string()), pa.array(share), pa.array(close)],
                    names=["doc_id", "lang_pred", "score", "ambiguous"],
                )

    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters")
    rows = docs.select(F.col("doc_id").cast("bigint"), "text", letters)
    return rows.mapInArrow(run, "doc_id bigint, lang_pred string, score double, ambiguous boolean")
