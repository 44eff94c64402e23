import pytest
from pyspark.sql import functions as F

ODD_TEXTS = [None, "", "   \n\t ", "A.", "word " * 3000, "1234 !!", "x" * 20000, "same text of seven words is here", "same text of seven words is here"]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, and columns whose names clash with results."""
    rows = [(i, t, "en" if i % 2 else None, "s" if i % 3 else None, 7) for i, t in enumerate(ODD_TEXTS)]
    rows += [(7, ODD_TEXTS[7], "en", "s", 7), (None, "a row without an id but with words", None, None, None), (None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns(
        {c: F.lit("clash") for c in ("score", "key", "row_id", "shards", "g", "_d", "n", "words", "start")}
    )


@pytest.fixture(scope="session")
def none(odd):
    return odd.filter("false")
