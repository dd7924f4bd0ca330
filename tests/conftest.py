import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tickloom.session import local_session

    return local_session(8)


@pytest.fixture(scope="session")
def folder():
    return SMALL


@pytest.fixture(scope="session")
def bars(spark, folder):
    from tickloom.catalog import views

    return views.bars(spark, folder)


def series(spark, rows, schema="ticker bigint, day int, close double"):
    """Indexed bars with open = high = low = close and volume 1, from (ticker, day, close)."""
    from pyspark.sql import functions as F

    from tickloom.plans.layout import index_bars

    df = spark.createDataFrame(rows, schema)
    price = {c: F.col("close") for c in ("open", "high", "low")}
    df = df.withColumns({"date": F.date_add(F.lit("2000-01-01").cast("date"), F.col("day")), **price})
    return index_bars(df.withColumn("volume", F.lit(1.0)).drop("day"))
