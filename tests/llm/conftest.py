import pytest


@pytest.fixture(scope="session")
def documents(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and repeated rows, a long text, and columns with names the operators use."""
    long_text = " ".join(f"w{i % 977} v{i % 31}" for i in range(60_000))
    words = " ".join(f"same{i}" for i in range(70))
    rows = [
        (1, words, "a", "en", 7, "x"),
        (2, words, "a", "en", 7, "x"),
        (2, words, "a", "en", 7, "x"),
        (3, words + " and more", None, None, None, None),
        (4, None, "a", None, None, "y"),
        (5, "", "b", "de", 1, "y"),
        (6, " \t\n\x0b ", "b", "de", 1, "y"),
        (7, "One", "b", "de", 1, "y"),
        (8, "one", "c", "fr", 1, "y"),
        (None, words, "c", "fr", 1, "y"),
        (None, None, None, None, None, None),
        (9, long_text, "c", "fr", 1, "y"),
        (10, long_text + " end", "c", "en", 1, "y"),
        (11, "÷½ Übér \U0001f600 naïve", "c", "en", 1, "y"),
        (12, "12345 ... !!!", "c", "en", 1, "y"),
    ]
    return spark.createDataFrame(
        rows, "doc_id bigint, text string, source string, lang string, size int, node string"
    )


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
