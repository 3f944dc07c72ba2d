"""Small tables with the odd rows that every operator must take."""

import pytest

LONG = "Lange " + "wort und satz " * 20_000


@pytest.fixture(scope="session")
def odd_rows():
    """(doc_id, text, lang, source, n_chars): nulls in each column, empty and very long texts, repeated rows, ties."""
    a = "the quick brown fox jumps over the lazy dog and then runs back home again to sleep"
    return [
        (1, a, "en", "s1", 1), (2, a, "en", "s2", 1), (3, None, "en", "s1", 0), (4, "", "de", "s1", 0), (5, "12 34 !!", "en", None, 8), (None, a + " indeed", "en", "s1", 1),
        (6, "ein satz über wörter und straßen", None, "s2", 5), (7, LONG, "de", "s3", len(LONG)), (8, a, None, None, None), (8, a, None, None, None), (9, "x", "en", "s1", 1), (None, None, None, None, None),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    return spark.createDataFrame(odd_rows, schema).cache()


@pytest.fixture(scope="session")
def clashing(odd):
    """The same with extra columns whose names the operators might use themselves."""
    from pyspark.sql import functions as F

    names = ["size", "row", "id", "_id", "_key", "node", "link", "shard", "fingerprint", "hits", "score", "target", "_h", "_v", "payload_digest", "n_lines_", "Text2", "_lid_"]
    return odd.select("*", *[F.lit(7).alias(n) for n in names])


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)
