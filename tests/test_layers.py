"""Layers follow their input; sketches stay within their stated errors."""

import datetime
import time

from pyspark.sql import functions as F

from tickloom.operators import sketches
from tickloom.sources import store


def test_a_changed_input_is_noticed(spark, tmp_path):
    source, built = str(tmp_path / "in"), []

    def build():
        built.append(1)
        return spark.read.parquet(source).groupBy().sum("id")

    def total():
        return store.layer(spark, source, "sum", build).first()[0]

    spark.range(10).write.parquet(source)
    assert (total(), total(), len(built)) == (45, 45, 1)
    before = store.layer(spark, source, "sum", build)
    spark.range(10, 12).write.mode("append").parquet(source)
    assert (total(), total(), len(built)) == (66, 66, 2)
    assert before.first()[0] == 45  # what was read from the old layer stays readable
    spark.range(3).write.mode("overwrite").parquet(source)
    assert (total(), len(built)) == (3, 3)


def test_dropped_layers_are_built_again(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "scratch", lambda spark, *parts: str(tmp_path.joinpath(*parts)))
    monkeypatch.setattr(store, "_WRITTEN", {})
    source = str(tmp_path / "in")
    spark.range(4).write.parquet(source)
    for _ in range(2):
        assert store.layer(spark, source, "kept", lambda: spark.read.parquet(source)).count() == 4
        assert (tmp_path / "layers").exists()
        store.drop_layers(spark)
        assert not (tmp_path / "layers").exists() and not store._WRITTEN


def test_sketches_of_many_instruments_and_of_odd_values(spark):
    day = datetime.date(2020, 1, 31)
    many = spark.range(60_000).select(
        (F.col("id") % 20_000).alias("ticker"), F.date_add(F.lit(day), (F.col("id") % 90).cast("int")).alias("date"),
        F.when(F.col("id") % 7 == 0, float("nan")).when(F.col("id") % 11 == 0, None).otherwise(F.col("id").cast("double")).alias("close"),
    )
    stored = sketches.monthly_sketches(many)
    whole = sketches.merged(stored, {}, {"median": 0.5}).first()
    assert whole["n_bars"] == 60_000
    assert abs(whole["instruments"] - 20_000) <= sketches.COUNT_ERROR * 20_000
    assert abs(whole["median"] / 60_000 - 0.5) <= sketches.RANK_ERROR
    nothing = many.where("isnan(close) or close is null")
    rows = sketches.merged(sketches.monthly_sketches(nothing), {"month": F.col("month")}, {"median": 0.5}).collect()
    assert len(rows) == 4 and all(r["median"] is None and r["instruments"] > 0 for r in rows)
    assert sketches.merged(sketches.monthly_sketches(many.where("false")), {"month": F.col("month")}, {}).count() == 0


def test_a_layer_leaves_no_shuffle_files(spark, tmp_path):
    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for name in found.mkString("\n").split("\n") if "shuffle_" in name}

    source = str(tmp_path / "in")
    spark.range(1000).write.parquet(source)
    before, setting = files(), spark.conf.get(store.FREE_SHUFFLES, None)
    made = store.layer(spark, source, "freed", lambda: spark.read.parquet(source).repartition("id").withColumn("x", F.lit(1)))
    until = time.time() + 20
    while (left := files() - before) and time.time() < until:
        time.sleep(0.2)
    assert not left
    assert made.count() == 1000 and spark.conf.get(store.FREE_SHUFFLES, None) == setting
