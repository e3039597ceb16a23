"""Tables with every awkward case, for all operators."""

import pytest

LONG = "word " * 40_000 + "x" * 30_000


@pytest.fixture(scope="session")
def odd(spark):
    """Null and repeated ids, null, empty, blank and very long texts, columns of clashing names."""
    rows = [
        (1, "The quick brown fox jumps over the lazy dog and runs away", "en", "a"), (2, None, None, None), (3, "", "en", "a"), (4, " \t\n", "en", None), (5, LONG, "en", "b"),
        (6, "The quick brown fox jumps over the lazy dog and runs away", "fr", "b"), (7, "é😀 ünï", "fr", ""), (7, "é😀 ünï", "fr", ""), (None, "no id here at all, really none", None, "a"), (None, None, None, None),
        (8, "one", "en", "a"), (9, "12345 67890", "en", "a"), (10, LONG, "en", "b"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    clash = ("_id", "_key", "id", "row", "n", "kept", "component_id", "_m_n", "text_", "_row", "score", "held")
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit("clash").alias(c) for c in clash])


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
