import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, node string, score string, key string, spans string, row string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, and columns named like inner ones."""
    long = ("the quick brown fox jumps over the lazy dog and runs away, " * 40 + "\n") * 60
    extra = ("a", "b", "c", "d", "e")
    rows = [
        (1, None, "en", "s", None, *extra),
        (2, "", None, None, 0, *extra),
        (3, long, "en", "s", len(long), *extra),
        (3, long, "en", "s", len(long), *extra),
        (4, "one", "en", "s", 3, None, None, None, None, None),
        (5, "one two three four five six seven", "en", "s", 33, *extra),
        (6, "one two three four five six seven", "en", "t", 33, *extra),
        (None, "one two three four five six seven", "en", "t", 33, *extra),
        (7, "x" * 70_000, "en", "t", 70_000, *extra),
        (8, " \n\t ", "en", "t", 4, *extra),
        (9, "token = abcdefgh12 mail a.b@c.de call +1 (555) 123-4567 ip 1.2.3.4 card 4111 1111 1111 1111", "en", "t", 90, *extra),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
