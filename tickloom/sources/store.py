"""Reading and writing tables, and layers kept between jobs."""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tickloom.session import shared_folder

_WRITTEN: dict[tuple[str, str], StructType] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def sql_over(spark: SparkSession, text: str, **frames: DataFrame) -> DataFrame:
    """SQL over data frames, which the text names in braces."""
    return spark.sql(text, **frames)


def scratch(spark: SparkSession, *parts: str) -> str:
    """A path of this application below the shared folder."""
    return os.path.join(shared_folder(spark), spark.sparkContext.applicationId, *parts)


def fresh(spark: SparkSession, name: str) -> str:
    """A path that no other call gets, so that frames read from it stay readable."""
    return scratch(spark, name, uuid.uuid4().hex)


def tag(source: str) -> str:
    """A short name for an input folder."""
    return hashlib.sha256(source.encode()).hexdigest()[:24]


def manifest(spark: SparkSession, source: str) -> str:
    """A short name for the files below a folder: their paths, sizes and times. Only the listing is read."""
    top = spark._jvm.org.apache.hadoop.fs.Path(source)
    files = top.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(top, True)
    found = []
    while files.hasNext():
        file = files.next()
        found.append(f"{file.getPath()} {file.getLen()} {file.getModificationTime()}")
    return tag("\n".join(sorted(found)))


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files; otherwise they stay until the driver collects its garbage."""
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREE_SHUFFLES)
        else:
            spark.conf.set(FREE_SHUFFLES, before)


def layer(
    spark: SparkSession, source: str, name: str, build: Callable[[], DataFrame]
) -> DataFrame:
    """Write ``build()`` to the shared folder once for each state of the input folder, then read it from there.

    Cuts the lineage between layers, and survives the loss of executors. When files of the input have
    come, gone or changed, the layer is built anew beside the old one, which frames made before may still read.
    The shuffle files of the building go with its end.
    """
    path = scratch(spark, "layers", f"{name}-{tag(source)}-{manifest(spark, source)}")
    key = (spark.sparkContext.applicationId, path)
    if key not in _WRITTEN:
        built = build()
        with shuffles_freed(spark):
            built.write.mode("overwrite").parquet(path)
        _WRITTEN[key] = built.schema
    return spark.read.schema(_WRITTEN[key]).parquet(path)


def drop_layers(spark: SparkSession) -> None:
    """Delete all layers of this application; frames that read them end with it."""
    delete(spark, scratch(spark, "layers"))
    application = spark.sparkContext.applicationId
    for key in [k for k in _WRITTEN if k[0] == application]:
        del _WRITTEN[key]


def kept(df: DataFrame, name: str) -> DataFrame:
    """Write a frame that is read several times to the shared folder, and read it from there."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def newest_file(spark: SparkSession, folder: str, pattern: str = "*.csv") -> str:
    """Path of the last written file; only the file listing is read, not the contents."""
    listing = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", True)
        .load(folder)
        .select("path", "modificationTime")
    )
    newest = listing.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path"))
    path = newest.first()["path"]
    if path is None:
        raise FileNotFoundError(f"no {pattern} in {folder}")
    return path


def read_latest_csv(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    return read_csv(spark, newest_file(spark, folder), schema)
