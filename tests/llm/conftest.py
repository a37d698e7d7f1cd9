import pytest

SF = "/root/testdata/sf0.001"
# Nulls, empty and blank texts, ties, repeated rows and ids, a very long text, other scripts, lone signs.
LONG = "the quick brown fox and the lazy dog of the house " * 8000
ODD = [
    (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, "   \n\t ", None, "a", 6), (4, "one", "en", None, 3), (4, "one", "en", None, 3), (5, "the cat sat on the mat", "en", "b", 22), (6, "The CAT sat on the mat", "en", "b", 22),
    (7, "12345 !!! 67", "en", "b", 12), (None, "no id here but some words", "en", "c", 25), (8, LONG, "en", None, len(LONG)), (9, "é𝄞 ß 東京 " * 3, "de", "c", 24), (10, "one two", "fr", "c", 7), (-5, "negative id with text", "en", "a", 21),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """A small table of edge cases, with columns whose names clash with those of the operators."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ODD, SCHEMA)
    return df.withColumns({c: F.lit("clash") for c in ("score", "fp", "size", "digest", "range", "order", "id", "term", "_key", "shard")})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
