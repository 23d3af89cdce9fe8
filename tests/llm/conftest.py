import pytest

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null ids and texts, empty and very long texts, ties, repeated rows, and clashing extra columns."""
    rows = [
        (1, None, 9, "x"),
        (2, "", 9, "x"),
        (3, "  \n ", 9, None),
        (4, "one", None, "y"),
        (5, "One two", 1, "y"),
        (6, "one  two\tTHREE four five six", 1, "y"),
        (6, "one  two\tTHREE four five six", 1, "y"),
        (7, "one two three four five six", 2, "z"),
        (8, "é" * 5 + " \U0001f600 " + "word " * 30_000, 2, "z"),
        (None, "no id here, mail a.b@c.example.org", 3, "z"),
        (-9, "mail a.b@c.example.org now", 3, "z"),
        (9, "<s>[INST] x </s>", 3, "z"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, part long, toxicity string")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def small_docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")
