"""Every registered query against its SQL, on the smallest tables."""

import pytest

import check
from tickloom.catalog import ORACLES, QUERIES, outcomes, views


@pytest.fixture(scope="module")
def con(folder):
    return check.database(folder)


#: Reviews that need instruments with several good years, of which the smallest tables have none.
MANY = ["occurrence_hist", "consistent_tickers", "join_qualified", "oos_verification", "verified_bin_counts"]
LARGER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, folder, name):
    verdict, rows, note = check.compare(spark, con, folder, name)
    assert verdict == ("same" if name in ORACLES else "rows"), note
    assert rows > 0 or name in MANY


@pytest.mark.parametrize("name", MANY)
def test_reviews(spark, name):
    verdict, rows, note = check.compare(spark, check.database(LARGER), LARGER, name)
    assert verdict == "same" and rows > (name != "verified_bin_counts"), note


def test_some_instruments_pass_and_some_do_not(spark):
    counts = outcomes.occurrence_counts(spark, LARGER)
    passed = counts.where(f"occurrence >= {views.ENOUGH}").count()
    assert 1 < passed < counts.count()


def test_names():
    assert set(ORACLES) <= set(QUERIES)
    assert not [n for n in QUERIES if "pipeline" in n or n.startswith("op")]
