"""Licences of files by notices they hold or inherit (operator 4).

Every line of a text is compared with known one-line notices, and every run of lines and every whole text
also with known headers and full licence texts (``license_texts``): the cosine of their TF-IDF vectors. A run
starts with a line and has as many words as the template; only runs and texts whose cosine can reach
``SAME``, by a bound from running sums, are worked out. How many texts have a word is counted over all of them, for the words of the templates
only; any other word weighs as much as one that no text has. So the vectors stay sparse and the table
of weights is as small as the templates.

A file whose best line, run or whole text reaches ``SAME`` has that licence. A file whose whole text reaches
it is a licence file and holds for its directory and all below. A file without
a notice of its own gets the licence of the nearest directory above it that has a licence file.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.license_texts import TEMPLATES
from tickloom.llm.shared import stored
from tickloom.llm.words import PLAIN, slices, split

SAME = 0.7
#: Words whose exact cosines are worked out at a time.
AT_ONCE = 1 << 20

# The customary one-line notices of common licences.
NOTICES = {
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD 3-clause license.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related rights (CC0 1.0).",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


class Notices:
    """Words of the notices and longer templates by hash, and their counts; the notices come first."""

    def __init__(self, notices: dict[str, str], longer: list[tuple[str, str]]) -> None:
        self.names = [*sorted(notices), *(name for name, _ in longer)]
        self.short = len(notices)
        texts = [*(notices[n] for n in self.names[: self.short]), *(text for _, text in longer)]
        words = split(pa.array(texts, pa.string()), PLAIN, fold=True)
        self.size = np.asarray(words.counts)
        self.vocabulary, number = np.unique(words.hash, return_inverse=True)
        self.counts = np.zeros((len(self.names), len(self.vocabulary)))
        np.add.at(self.counts, (np.repeat(np.arange(len(self.names)), words.counts), number), 1)
        self.in_notice = self.counts[: self.short].any(axis=0)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at, -1)


def _frequencies(notices: Notices):
    """How many texts have each word of the notices; the number of texts stands under -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, texts = np.zeros(len(notices.vocabulary), np.int64), 0
        for batch in batches:
            texts += batch.num_rows
            for part in slices(batch, "text"):
                words = split(part.column("text"), PLAIN, fold=True)
                number = notices.numbers(words.hash)
                text = np.repeat(np.arange(part.num_rows), words.counts)[number >= 0]
                own = np.unique(text * len(total) + number[number >= 0]) % max(1, len(total))
                total += np.bincount(own, minlength=len(total))
        yield pa.record_batch(
            [pa.array(np.arange(-1, len(total), dtype=np.int32)), pa.array(np.concatenate([[texts], total]))],
            names=["word", "n"],
        )

    return run


def _cosines(
    notices: Notices, weight: np.ndarray, most: float, words, line: np.ndarray, lines: int, among: int
) -> np.ndarray:
    """Cosine of each line to each of the first ``among`` templates."""
    known = notices.numbers(words)
    order = np.lexsort((words, line))
    l, w, k = line[order], words[order], known[order]
    fresh = np.concatenate([[True], (l[1:] != l[:-1]) | (w[1:] != w[:-1])]) if len(l) else np.zeros(0, bool)
    count = np.diff(np.append(np.flatnonzero(fresh), len(l)))
    l, k = l[fresh], k[fresh]
    value = count * np.where(k >= 0, weight[np.maximum(k, 0)] if len(weight) else most, most)
    norm = np.sqrt(np.bincount(l, value * value, minlength=lines))
    own = k >= 0
    notice = notices.counts[:among] * weight
    length = np.sqrt((notice * notice).sum(axis=1))
    out = np.zeros((lines, among))
    np.add.at(out, l[own], value[own, None] * notice[:, k[own]].T)
    return out / np.maximum(norm[:, None] * length[None, :], 1e-300)


def _likely(notices: Notices, weight: np.ndarray, most: float, known: np.ndarray, first: np.ndarray, start: np.ndarray):
    """First word and end of the whole texts and runs of lines that can be like a template.

    The dot product is a difference of running sums. The squared norm is at least the sum over all
    words of their squared weights, so the cosine is not above the bound.
    """
    own, k = known >= 0, np.maximum(known, 0)
    square = weight * weight
    mass = np.concatenate([[0], np.cumsum(np.where(own, square[k], most * most))])
    text_end = first[np.searchsorted(first, start, side="right")]
    length = np.sqrt((notices.counts**2 * square).sum(axis=1))
    found = []
    for t, size in enumerate(notices.size.tolist()):
        dot = np.concatenate([[0], np.cumsum(np.where(own, (notices.counts[t] * square)[k], 0))])
        begin, end = first[:-1], first[1:]
        if t >= notices.short:
            begin, end = np.append(begin, start), np.append(end, np.minimum(start + size, text_end))
        bound = (dot[end] - dot[begin]) / np.maximum(np.sqrt(np.maximum(mass[end] - mass[begin], 0)) * length[t], 1e-300)
        good = bound >= SAME - 1e-6
        found.append(np.stack([begin[good], end[good]], axis=1))
    return np.unique(np.concatenate(found), axis=0)


def _longer(notices: Notices, weight: np.ndarray, most: float, words, known: np.ndarray, line: np.ndarray):
    """Text, best template, its cosine, and whether it is the whole text, of what ``_likely`` finds."""
    first = np.concatenate([[0], np.cumsum(words.counts)]).astype(np.int64)
    if not len(known) or not len(weight):
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0), np.zeros(0, bool))
    start = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
    part = _likely(notices, weight, most, known, first, start)
    size = part[:, 1] - part[:, 0]
    chunk = np.cumsum(size) // AT_ONCE
    best, score = np.zeros(len(part), np.int64), np.zeros(len(part))
    for c in np.unique(chunk):
        rows = np.flatnonzero(chunk == c)
        length = size[rows]
        number = np.repeat(np.arange(len(rows)), length)
        at = np.arange(len(number)) - np.repeat(np.cumsum(length) - length, length) + part[rows, 0][number]
        cosine = _cosines(notices, weight, most, words.hash[at], number, len(rows), len(notices.names))
        best[rows] = np.argmax(cosine, axis=1)
        score[rows] = cosine.max(axis=1)
    text = np.searchsorted(first, part[:, 0], side="right") - 1
    return text, best, score, (part[:, 0] == first[text]) & (part[:, 1] == first[text + 1])


def _scan(notices: Notices, weight: np.ndarray, most: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = split(part.column("text"), PLAIN, fold=True)
                ends = np.flatnonzero(words.data == 0x0A)
                text = np.repeat(np.arange(part.num_rows), words.counts)
                line = np.searchsorted(ends, words.start) + text  # a line ends where its text does
                known = notices.numbers(words.hash)
                # only lines with a word of the notices can be like one
                near = known >= 0
                near[near] = notices.in_notice[known[near]]
                hit = np.unique(line[near])
                at = np.minimum(np.searchsorted(hit, line), max(0, len(hit) - 1))
                own = hit[at] == line if len(hit) else np.zeros(len(line), bool)
                cosine = _cosines(notices, weight, most, words.hash[own], at[own], len(hit), notices.short)
                owner = np.zeros(len(hit), np.int64)
                owner[at[own]] = text[own]
                best = np.argmax(cosine, axis=1) if cosine.size else np.zeros(len(hit), np.int64)
                score = cosine[np.arange(len(hit)), best] if cosine.size else np.zeros(len(hit))
                more = _longer(notices, weight, most, words, known, line)
                whole = np.zeros(part.num_rows, bool)
                whole[more[0][more[3] & (more[2] >= SAME)]] = True
                owner, best, score = (np.concatenate(x) for x in zip((owner, best, score), more))
                order = np.lexsort((best, -score, owner))
                first = order[np.unique(owner[order], return_index=True)[1]]
                name, top = np.full(part.num_rows, -1), np.zeros(part.num_rows)
                name[owner[first]], top[owner[first]] = best[first], score[first]
                found = top >= SAME
                names = np.array([*notices.names, None], object)
                yield pa.record_batch(
                    [
                        part.column("doc_id"),
                        part.column("path"),
                        pa.array(names[np.where(found, name, -1)], pa.string()),
                        pa.array(top),
                        pa.array(found & whole),
                    ],
                    names=["doc_id", "path", "own", "score", "is_file"],
                )

    return run


def _directory(path: Column) -> Column:
    """All of a path before its last part; null where there is none."""
    cut = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return F.when(path.contains("/"), cut)


def scan(
    files: DataFrame, notices: dict[str, str] | None = None, longer: list[tuple[str, str]] | None = None
) -> DataFrame:
    """The licence of each row of ``files`` (doc_id, path, text).

    Returns doc_id, path, license (null if none is found), score (cosine of the best line, or of
    a run of lines or the whole text where that is better and reaches ``SAME``; 0 without any known word), inherited, license_path (the licence file it comes from, null if its own). Of several
    licence files in a directory the smallest path counts. A null text has no lines, a null path no
    directory. ``longer`` has licences and texts for runs of lines; with ``notices`` alone there are none. Repeated rows are scanned one by one; an empty table gives no rows.
    """
    if longer is None:
        longer = TEMPLATES if notices is None else []
    known = Notices(NOTICES if notices is None else notices, longer)
    rows = files.select(F.col("doc_id").cast("bigint"), F.col("path").cast("string"), "text")
    # one row per word of the templates
    counts = (
        rows.select("text").mapInArrow(_frequencies(known), "word int, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    ).toArrow()
    n = dict(zip(counts["word"].to_pylist(), counts["n"].to_pylist()))
    texts = n.get(-1, 0)
    weight = np.array([np.log((1 + texts) / (1 + n.get(i, 0))) + 1 for i in range(len(known.vocabulary))])
    most = float(np.log(1 + texts) + 1)
    scanned = rows.mapInArrow(
        _scan(known, weight, most), "doc_id bigint, path string, own string, score double, is_file boolean"
    ).withColumn("directory", _directory(F.col("path")))
    scanned = stored(scanned, "licences")
    holders = (
        scanned.where("is_file and directory is not null")
        .groupBy("directory")
        .agg(F.min(F.struct("path", "own")).alias("holder"))
    )
    parts = F.split("directory", "/")
    above = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, F.lit(1), k), "/").alias("up"))))
    directories = scanned.where("directory is not null").select("directory").distinct().select("directory", above.alias("a"))
    nearest = (
        directories.join(holders.withColumnRenamed("directory", "up"), F.col("a.up") == F.col("up"))
        .groupBy(directories["directory"].alias("below"))
        .agg(F.max_by("holder", "a.depth").alias("holder"))
    )
    missing = F.col("own").isNull() & F.col("holder").isNotNull()
    return scanned.join(nearest, F.col("directory") == F.col("below"), "left").select(
        "doc_id",
        "path",
        F.coalesce("own", "holder.own").alias("license"),
        "score",
        missing.alias("inherited"),
        F.when(missing, F.col("holder.path")).alias("license_path"),
    )
