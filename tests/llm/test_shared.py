import os

import pytest
from pyspark.sql import functions as F

from tickloom.llm.shared import QUERIES, matching, query, stored, text_key, workspace


def path_of(df):
    return os.path.dirname(df.inputFiles()[0]).removeprefix("file://").removeprefix("file:")


def test_workspaces_delete_what_is_not_kept(spark):
    with workspace(spark):
        a = path_of(stored(spark.range(3), "a"))
        with workspace(spark):
            b = path_of(stored(spark.range(3), "b"))
            kept = stored(spark.range(3), "kept", keep=True)
        assert os.path.exists(a) and not os.path.exists(b) and kept.count() == 3
        outer = stored(spark.range(4), "outer", keep=True)
        inner = path_of(kept)
    assert not os.path.exists(a) and not os.path.exists(inner) and outer.count() == 4
    with pytest.raises(ZeroDivisionError), workspace(spark):
        c = path_of(stored(spark.range(3), "c"))
        1 / 0
    assert not os.path.exists(c)


def test_matching(odd):
    docs = odd.withColumn("high", F.lit("clash"))
    key = text_key(F.col("text"))
    rows = docs.where("doc_id in (2, 4) or doc_id is null").select("doc_id", key.high.alias("high"), key.low.alias("low"))
    one = matching(docs, rows, "one")
    assert one.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"] is None) for r in one.collect()) == [(0, False), (0, True), (2, False), (4, True)]
    assert matching(docs, rows, "others").count() == docs.count() - 5


def test_names_are_registered_once():
    query("test_only")(lambda spark, folder: None)
    with pytest.raises(ValueError):
        query("test_only")(lambda spark, folder: None)
    QUERIES.pop("test_only")
