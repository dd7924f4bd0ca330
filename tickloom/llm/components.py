"""Connected components of a table of links, by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.shared import stored, workspace


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Join the neighbours of each number to the smallest one among them and itself.

    ``large`` moves the neighbours above it, otherwise those below it and itself. The
    smallest neighbour is found with partial sums and joined back, so a number with very
    many links is spread by the join.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        moved = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("low"))
        moved = down.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        moved = moved.unionByName(low.select("a", F.col("low").alias("b")))
    return moved.where("a <> b").distinct()


def _unfinished(edges: DataFrame) -> DataFrame:
    """Numbers that point to two others, or point to one and are pointed to: without any, all are stars."""
    points = edges.select(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into"))
    pointed = edges.select(F.col("b").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into"))
    ends = points.unionByName(pointed).groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return ends.where("out > 1 or (out = 1 and into = 1)")


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every number in ``links`` (a, b): the smallest number it is linked with.

    Null ends are left out, a link of a number to itself gives it a row. The number of
    rounds grows with the logarithm of the longest chain; each round is written to the
    shared folder, and only whether it was the last reaches the driver.
    """
    with workspace(links.sparkSession):
        return stored(_components(links), "components", keep=True)


def _components(links: DataFrame) -> DataFrame:
    links = links.where("a is not null and b is not null").select("a", "b")
    links = stored(links, "links")
    edges = links.where("a <> b").distinct()
    while True:
        edges = stored(_star(_star(edges, True), False), "stars")
        if _unfinished(edges).isEmpty():
            break
    ends = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node")))
    found = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return (
        ends.distinct()
        .join(found, "node", "left")
        .select("node", F.coalesce("label", "node").alias("label"))
    )
