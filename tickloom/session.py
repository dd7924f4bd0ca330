"""Spark session for tests and benchmarks, and the folder shared by all executors."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

_LOCAL_FOLDERS: dict[str, str] = {}


def local_session(cores: int | str = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the benchmark. On a cluster, use the session it gives."""
    cores = str(cores)
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tickloom")
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, read from ``spark.checkpoint.dir``.

    A local session without that setting gets a new folder of its own. A cluster
    session without it is refused, since a folder on one machine would not do.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = context.applicationId
    if app not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[app] = tempfile.mkdtemp(prefix="tickloom-")
    return _LOCAL_FOLDERS[app]


def use_checkpoints(spark: SparkSession) -> None:
    """Point ``DataFrame.checkpoint`` at the shared folder when the session has none yet."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(os.path.join(shared_folder(spark), "checkpoints"))
