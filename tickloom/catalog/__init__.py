"""Every query of the library on the given tables, with comparison SQL where SQL can say it."""

from tickloom.catalog import (  # noqa: F401  (importing registers the queries)
    indicators,
    live,
    long,
    outcomes,
    prediction,
    rolling,
    tables,
)
from tickloom.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
