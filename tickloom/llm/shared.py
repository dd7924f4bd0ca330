"""Tables between steps, kept in the folder all executors share, and the registered queries."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.sources.store import scratch

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``, with its SQL where there is one."""

    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own for each call, below the shared folder."""
    return scratch(spark, "llm", f"{name}-{uuid.uuid4().hex}")


#: Paths of the tables of each open workspace, the innermost last.
_OPEN: list[list[str]] = []


@contextmanager
def workspace(spark: SparkSession) -> Iterator[None]:
    """Tables stored inside are deleted at the end, but for those that are kept.

    What is returned from a workspace may only read kept tables. A kept table of an inner
    workspace belongs to the one around it.
    """
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def stored(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write a table to the shared folder and read it from there. Cuts the lineage."""
    path = new_path(df.sparkSession, name)
    owner = _OPEN[: -1 if keep else None]
    if owner:
        owner[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_key(text: Column) -> Column:
    """128 bits that stand for a text; null has a key of its own."""
    return F.struct(
        F.xxhash64(text, F.lit("a")).alias("high"), F.xxhash64(F.lit("b"), text).alias("low")
    )


def matching(docs: DataFrame, rows: DataFrame, which: str) -> DataFrame:
    """Rows of ``docs`` whose doc_id and text stand in ``rows`` (doc_id, high, low: see ``text_key``).

    ``which`` is "one" for one row of each such pair, or "others" for the rows that do not stand there.
    All columns of ``docs`` are kept, whatever their names. Null doc_ids match each other.
    """
    identity = ["id_null", "id", "high", "low"]

    def named(doc_id: Column, high: Column, low: Column) -> list[Column]:
        doc_id = doc_id.cast("bigint")
        return [c.alias(n) for c, n in zip((doc_id.isNull(), F.coalesce(doc_id, F.lit(0)), high, low), identity)]

    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    given = docs.select(row).select("row", F.col("row.doc_id").alias("i"), text_key(F.col("row.text")).alias("k"))
    given = given.select("row", *named(F.col("i"), F.col("k.high"), F.col("k.low")))
    wanted = rows.select(*named(F.col("doc_id"), F.col("high"), F.col("low"))).distinct()
    if which == "others":
        return given.join(wanted, identity, "left_anti").select("row.*")
    found = given.join(wanted, identity, "left_semi")
    return found.groupBy(*identity).agg(F.first("row").alias("row")).select("row.*")
