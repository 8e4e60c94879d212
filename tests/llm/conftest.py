import pytest

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, log_weight string, component_id long, passes int, key string, order int, _copy int, _row int, _hash string, c0 string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows; extra columns with names that operators use."""
    long = " ".join(f"w{i * i % 997}" for i in range(30_000))
    rows = [
        (1, None, None, None), (2, "", "en", None), (3, " \t\n", "en", "a"), (4, "One two", "en", "a"), (5, "one TWO", None, "a"), (6, long, "de", "b"),
        (7, long + " x", "de", "b"), (8, "The same words here again and again.", "en", "c"), (8, "The same words here again and again.", "en", "c"),
        (9, "...!!! 123", "en", ""), (10, "caf\u00e9 \U0001f600 \x00 end", "fr", "c"),
    ]
    return spark.createDataFrame([(*r, None, "x", 7, 5, "k", 1, 2, 3, "h", "c") for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def none(odd):
    return odd.filter(F.lit(False))
