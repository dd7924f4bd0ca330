"""Every registered query on the smallest tables, against its SQL where it has one."""

import pytest

import check
from tickloom.llm import queries  # noqa: F401  (registers the queries)
from tickloom.llm.shared import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(folder):
    return check.database(folder)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, folder, name):
    verdict, rows, note = check.compare(spark, con, folder, name)
    assert verdict == ("same" if name in ORACLES else "rows"), note
    assert rows > 0


def test_all_operators_have_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
