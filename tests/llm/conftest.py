import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

LONG = "the quick brown fox jumps over a lazy dog and " * 4000

EDGE = [
    (1, None, "en", "a", None),
    (2, "", None, "a", 0),
    (3, "one two", "en", None, 7),
    (4, "one two", "en", "b", 7),
    (5, LONG, "en", "b", len(LONG)),
    (None, "a line of words that nobody else in this small table has written down", None, "b", None),
    (6, " \t\n ", "fr", "c", 4),
    (7, "été über ñandú 東京 😀 words with accents and other letters in them today", "fr", "c", 10),
    (7, "été über ñandú 東京 😀 words with accents and other letters in them today", "fr", "c", 10),
    (8, "x" * 5000, "en", "a", 5000),
    (9, "hello <|endoftext|> world, and <|endoftext|>", "en", "a", None),
]


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls in every column, empty and long texts, repeated rows, ties and
    columns whose names clash with those that operators use."""
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(EDGE, DOCS)
    return rows.withColumns({c: F.lit("clash") for c in ("key", "size", "shard", "fp", "length", "_salt", "kept", "src", "copies")})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def documents(spark, data_dir):
    return spark.read.parquet(f"{data_dir}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text or "" for r in documents.collect()}
