import pytest

from oresmith.llm.common import ship_package


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship_package(spark)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """NULLs, empty and blank texts, repeated rows, a long text, and columns named like results."""
    rows = [
        (1, "one two three four", "en", 0.5),
        (1, "one two three four", "en", 0.5),
        (2, None, None, None),
        (3, "", "fr", 1.0),
        (4, " \n\t\n ", None, 2.0),
        (None, "one two three four", "en", None),
        (5, "word " * 20_000, "en", 3.0),
        (6, "12345 !?", "de", 4.0),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
