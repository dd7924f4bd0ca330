"""Exact top-k by inner product with a bit-sliced index (operator 5).

Vectors are whole numbers. The index is a table of blocks; a block holds the vectors of some rows
and, for each attribute, the upper ``BITS`` bits of their values as bitmaps (slices): bit j of all rows
is one bitmap.

For a query, the score is added up for all rows of a block at once, bitmap by bitmap: the upper
``WEIGHT_BITS`` bits of each weight add the attribute's slices, shifted, with full adders made of bitwise operations.
For negative weights the complement is added. The sum is again a list of bitmaps. The k-th highest sum is found
from its most significant slice downward. What the dropped bits can change is known for each query, so
all rows whose sum lies within that distance of the k-th are candidates, again by a walk
down the slices, and only these are scored exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.shared import stored

#: Rows in a block, queries that are sent to it together, and those that are added up at a time.
ROWS, QUERIES, AT_ONCE = 8192, 1024, 128
BITS, WEIGHT_BITS = 5, 4
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def _packed(bits: np.ndarray) -> np.ndarray:
    """Rows of truth values as bitmaps of 64-bit words."""
    padded = np.zeros((*bits.shape[:-1], -(-bits.shape[-1] // 64) * 64), bool)
    padded[..., : bits.shape[-1]] = bits
    return np.packbits(padded, axis=-1, bitorder="little").view("<u8")


class Slices:
    """The bit-sliced attributes of a block of vectors (row x attribute)."""

    def __init__(self, values: np.ndarray) -> None:
        self.values = values
        self.rows, self.width = values.shape
        self.low = values.min(axis=0)
        reach = (values - self.low).max(axis=0)
        self.shift = np.array([max(0, int(r).bit_length() - BITS) for r in reach])
        upper = ((values - self.low) >> self.shift).T
        self.slices = np.stack([_packed((upper >> j & 1).astype(bool)) for j in range(BITS)], axis=1)
        self.real = _packed(np.ones(self.rows, bool))

    def sums(self, queries: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Slices of the sum for each query, and how far a sum can be from the true order."""
        size = np.abs(queries)
        # weight times step of the attribute, in units that keep WEIGHT_BITS bits of the largest
        scaled = size << self.shift
        unit = np.array([max(0, int(m).bit_length() - WEIGHT_BITS) for m in scaled.max(axis=1)])
        weight = scaled >> unit[:, None]
        top = (1 << BITS) - 1
        # true score = constant + weight * upper * 2**unit + rest, with rest in a known range
        cut = (scaled - (weight << unit[:, None])) * top + size * ((1 << self.shift) - 1)
        slack = -(-cut.sum(axis=1) >> unit) + 1
        flip = np.where(queries < 0, _ALL, np.uint64(0))
        shape = (len(queries), self.slices.shape[-1])
        planes: list[np.ndarray] = []
        for d in range(self.width):
            for i in range(int(weight[:, d].max(initial=0)).bit_length()):
                own = np.flatnonzero(weight[:, d] >> i & 1)
                if len(own):
                    self._add(planes, own, i, self.slices[d][:, None, :] ^ flip[own, d][None, :, None], shape)
        return planes, slack

    def _add(self, planes: list[np.ndarray], own: np.ndarray, at: int, number: np.ndarray, shape) -> None:
        """Add a number of BITS slices, shifted by ``at``, to the sums of some queries."""
        carry = np.zeros((len(own), shape[1]), np.uint64)
        k = at
        while True:
            while len(planes) <= k:
                planes.append(np.zeros(shape, np.uint64))
            old = planes[k][own]
            if k - at < BITS:
                x = number[k - at]
                half = old ^ x
                planes[k][own] = half ^ carry
                carry = (old & x) | (half & carry)
            else:
                planes[k][own] = old ^ carry
                carry = old & carry
            k += 1
            if k - at >= BITS and not carry.any():
                return

    def candidates(self, queries: np.ndarray, k: int) -> Iterator[np.ndarray]:
        """For each query the rows that can be among its ``k`` best."""
        planes, slack = self.sums(queries)
        sure = np.zeros((len(queries), len(self.real)), np.uint64)
        equal = np.broadcast_to(self.real, sure.shape).copy()
        kth = np.zeros(len(queries), np.int64)
        for j in range(len(planes) - 1, -1, -1):
            more = sure | (equal & planes[j])
            enough = np.bitwise_count(more).sum(axis=1) >= min(k, self.rows)
            kth += enough.astype(np.int64) << j
            equal &= np.where(enough[:, None], planes[j], ~planes[j])
            sure = np.where(enough[:, None], sure, more)
        floor = np.maximum(kth - slack, 0)
        above = np.zeros_like(sure)
        equal = np.broadcast_to(self.real, sure.shape).copy()
        for j in range(len(planes) - 1, -1, -1):
            one = (floor >> j & 1).astype(bool)[:, None]
            above = np.where(one, above, above | (equal & planes[j]))
            equal &= np.where(one, planes[j], ~planes[j])
        good = np.unpackbits((above | equal).view(np.uint8), axis=1, bitorder="little")
        for row in good:
            yield np.flatnonzero(row[: self.rows])

    def best(self, queries: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int):
        """Query, row and exact score of the ``k`` best of each query, its own id left out."""
        found = []
        # room for all rows under a query's own id, of which there may be several
        known, many = np.unique(ids, return_counts=True)
        most = int(many[np.isin(known, own)].max(initial=0))
        for q, rows in enumerate(self.candidates(queries, k + most)):
            rows = rows[ids[rows] != own[q]]
            score = self.values[rows] @ queries[q]
            first = np.lexsort((ids[rows], -score))[:k]
            found.append((np.full(len(first), q), rows[first], score[first]))
        return (np.concatenate(x) for x in zip(*found))


def whole_numbers(vectors: DataFrame, copies: int = 1) -> DataFrame:
    """(vec_id, width, vector): floor(256 x) of each component; rows that take no part are left out.

    These are rows without vec_id, null or empty vectors, and vectors with a null, NaN or infinite
    component. A row repeated in full comes as often as it stands there, up to ``copies`` times. Components
    must be below 2**20 in size.
    """
    x = F.col("embedding")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    numbers = F.transform(x, lambda v: F.floor(v.cast("double") * 256).cast("bigint"))
    rows = vectors.select(F.col("vec_id").cast("bigint"), "embedding").where(
        x.isNotNull() & F.col("vec_id").isNotNull() & (F.size(x) > 0)
    )
    rows = rows.where(~bad).select("vec_id", F.size(x).alias("width"), numbers.alias("vector"))
    counted = rows.groupBy("vec_id", "width", "vector").agg(F.count(F.lit(1)).alias("times"))
    turns = F.explode(F.sequence(F.lit(1), F.least("times", F.lit(copies))))
    return counted.withColumn("copy", turns).select("vec_id", "width", "vector")


def _matrix(lists: pa.ListArray, width: int) -> np.ndarray:
    return lists.flatten().to_numpy().astype("<i8").reshape(-1, width)


def _pack(table: pa.Table) -> pa.Table:
    """The rows of a block as one row."""
    table = table.sort_by("vec_id")
    values = _matrix(table["vector"].combine_chunks(), table["width"][0].as_py())
    if np.abs(values).max(initial=0) >= 1 << 28:
        raise ValueError("a component is too large for exact scores")
    return pa.table(
        {
            "width": table["width"][:1],
            "block": table["block"][:1],
            "ids": pa.array([table["vec_id"].to_numpy().astype("<i8").tobytes()], pa.binary()),
            "numbers": pa.array([values.astype("<i4").tobytes()], pa.binary()),
        }
    )


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    many = rows.groupBy(F.col("width").alias("w")).agg(F.ceil(F.count("*") / size).alias("blocks"))
    block = F.pmod(F.xxhash64("vec_id", "vector"), F.col("blocks")).cast("int")
    dealt = rows.join(many, F.col("width") == F.col("w")).withColumn("block", block)
    packed = dealt.select("width", "block", "vec_id", "vector").groupBy("width", "block").applyInArrow(
        _pack, "width int, block int, ids binary, numbers binary"
    )
    return stored(packed, "blocks")


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                ids = np.frombuffer(row["ids"], "<i8")
                values = np.frombuffer(row["numbers"], "<i4").reshape(len(ids), -1).astype(np.int64)
                own = np.frombuffer(row["query_ids"], "<i8")
                queries = np.frombuffer(row["query_numbers"], "<i4").reshape(len(own), -1).astype(np.int64)
                block = Slices(values)
                for at in range(0, len(own), AT_ONCE):
                    q, found, score = block.best(queries[at : at + AT_ONCE], own[at : at + AT_ONCE], ids, k)
                    yield pa.record_batch(
                        [
                            pa.array(own[q + at]),
                            pa.array(q + at + row["query_block"] * (1 << 20)),
                            pa.array(ids[found]),
                            pa.array(score),
                        ],
                        names=["query_id", "place", "vec_id", "score"],
                    )

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` highest inner products of each query with rows of ``vectors`` under another vec_id.

    Both have vec_id and embedding (see ``whole_numbers`` for the rows that take part). Returns query_id, rank
    (from 1), vec_id, score; ties go to the smaller vec_id, fewer rows give fewer results. Only
    vectors of the query's length are candidates. Of several vectors under one query id each is a query; a query
    repeated in full is asked once, while a candidate repeated in full counts each time. Without vectors or queries there
    are no rows.
    """
    # more than k equal rows are never among the k best of a query
    index = _blocks(whole_numbers(vectors, k), ROWS)
    asked = _blocks(whole_numbers(queries), QUERIES)
    asked = asked.select(
        F.col("width").alias("query_width"),
        F.col("block").alias("query_block"),
        F.col("ids").alias("query_ids"),
        F.col("numbers").alias("query_numbers"),
    )
    # each block of rows once for each block of the stated queries
    turns = asked.groupBy(F.col("query_width").alias("w")).agg(F.max("query_block").alias("last"))
    pairs = (
        index.join(turns, F.col("width") == F.col("w"))
        .withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("last"))))
        .join(asked, (F.col("width") == F.col("query_width")) & (F.col("turn") == F.col("query_block")))
        .repartition("width", "block", "turn")
    )
    found = pairs.select("ids", "numbers", "query_block", "query_ids", "query_numbers").mapInArrow(
        _search(k), "query_id bigint, place bigint, vec_id bigint, score bigint"
    )
    best = Window.partitionBy("query_id", "place").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
