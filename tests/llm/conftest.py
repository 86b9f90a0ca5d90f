import pytest
from pyspark.sql import types as T

EDGE = "doc_id long, text string, lang string, source string, n_chars long, kept string, score double, component_id long, _1 string"


@pytest.fixture(scope="session")
def documents(spark):
    """Rows with nulls everywhere, empty and long texts, ties, repeats and columns whose names clash."""
    base = "the quick brown fox jumps over the lazy dog while seven wizards boil jugs of magic potion near river bank seven times each night"
    rows = [
        (1, base, "en", "a", len(base), "x", 0.1, 9, None),
        (2, base, "en", "a", len(base), "x", 0.1, 9, None),
        (2, base, "en", "a", len(base), "x", 0.1, 9, None),
        (3, base + " again", None, None, None, None, None, None, None),
        (4, None, "en", "a", None, None, None, None, None),
        (5, "", "en", "a", 0, None, None, None, None),
        (6, " \n\t \n", "en", "a", 5, None, None, None, None),
        (7, "word", "en", "a", 4, None, None, None, None),
        (8, "word", "en", "a", 4, None, None, None, None),
        (None, base, "en", "a", len(base), None, None, None, None),
        (None, None, None, None, None, None, None, None, None),
        (9, " ".join(f"w{i * 7919 % 30011}" for i in range(30_000)), "en", "a", None, None, None, None, None),
        (10, "x" * 50_000, "en", "a", 50_000, None, None, None, None),
        (11, "Ünïcödé — 漢字   text 😀 with odd spaces", "de", "b", 30, None, None, None, None),
    ]
    return spark.createDataFrame(rows, EDGE)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], EDGE)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(12)] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
