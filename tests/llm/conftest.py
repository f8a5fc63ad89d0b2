import pytest

ROWS = [
    (1, "The quick brown fox jumps over the lazy dog and then it's gone. don't we're", "en"),
    (1, "The quick brown fox jumps over the lazy dog and then it's gone. don't we're", "en"),
    (None, "Password: hunter2hunter2 and more   words\n\n here", None),
    (2, None, "en"),
    (3, "", "fr"),
    (4, "12345 !!! 😀 漢字 ñandú ½ <|endoftext|> tail", "xx"),
    (5, "word " * 30_000 + "end", "en"),
    (6, " \t\n ", None),
    (7, "x" * 50_000, "en"),
]
SCHEMA = "doc_id long, text string, lang string"
#: Columns whose names operators might want for themselves.
CLASH = ("id", "score", "spans", "_spans", "hits", "_hits", "fingerprint", "_fingerprint", "batch", "gram", "n", "key", "rank", "digest", "first", "side", "tie", "part", "N_CHARS", "source")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, repeated rows, empty and long texts, and columns with clashing names."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ROWS, SCHEMA)
    return df.withColumns({c: F.lit("z") for c in CLASH}).cache()


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
