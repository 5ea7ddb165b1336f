import pytest

from tests.conftest import ROOT, SF, duck, same, spark  # noqa: F401

#: Clashing names among the extra columns, nulls, empty and blank texts, ties, repeated rows, a long text and near copies of it.
WORDS = [f"w{i * 7919 % 1000}x{i}" for i in range(30000)]
LONG = " ".join(WORDS)
EDGE = [
    (1, None, "en"), (2, "", None), (3, "  \n\t ", "en"), (4, "a", "de"), (5, "One two three four five", "en"), (6, "one TWO three four five", "en"), (6, "one TWO three four five", "en"),
    (None, "Null id here, five words and more", "fr"), (None, None, None), (8, LONG, "en"), (9, LONG + " and a tail", "en"), (9, LONG + " and a tail", "en"), (10, "é" * 5000, "fr"), (11, "aaaa " * 3000, "en"),
]


@pytest.fixture(scope="session")
def edge(spark):  # noqa: F811
    rows = [(i, t, lang, "s", 0, 1, 2, "k", "m", 3.0) for i, t, lang in EDGE]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, chunk int, bucket int, kind string, mark string, score double")


@pytest.fixture(scope="session")
def none(spark, edge):  # noqa: F811
    return spark.createDataFrame([], edge.schema)


@pytest.fixture(scope="session")
def sf():
    return SF
