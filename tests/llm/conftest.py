import numpy as np
import pytest


@pytest.fixture(scope="session")
def uri(tmp_path_factory):
    return lambda name: f"file://{tmp_path_factory.mktemp(name)}/x"


@pytest.fixture
def rng():
    return np.random.default_rng(5)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows and columns that clash with the operators' own."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, k string, node int, id int, digest string"
    rows = [
        (1, None, "en", "h", 0, "a", 1, 1, "x"),
        (2, "", None, None, None, None, None, None, None),
        (3, "  \n ", "fr", "h", 4, "b", 2, 2, "y"),
        (4, "one two three", "en", "h", 13, "c", 3, 3, "z"),
        (4, "one two three", "en", "h", 13, "c", 3, 3, "z"),
        (5, "one two three", "en", "h", 13, "c", 3, 3, "z"),
        (None, "one two three", "en", None, 13, None, None, None, None),
        (None, None, None, None, None, None, None, None, None),
        (6, "word " * 30000, "en", "g", 150000, "d", 4, 4, "w"),
        (7, "日本語 😀 <|endoftext|> naïve ÀÉ", "de", "g", 30, "e", 5, 5, "v"),
    ]
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
