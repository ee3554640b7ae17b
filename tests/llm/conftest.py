import pytest

LONG = "word " * 40000 + "end"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null, empty and blank texts, a very long one, repeated rows, a null id, and columns with clashing names."""
    rows = [
        (1, None), (2, ""), (3, " \n\t "), (4, LONG), (5, "the same row twice"), (5, "the same row twice"), (None, "no id"), (6, "naïve café – “quoted” 日本語 😀\x00  end"), (7, "a\n\nb\r\nc"), (8, "the same row twice"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.selectExpr("doc_id", "text", "'x' AS row", "1.5D AS score", "'y' AS n_words", "cast(null AS string) AS lang", "7L AS fp", "'z' AS media")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
