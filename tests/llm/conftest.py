import random

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASHES = "text_key string, keep_id string, label string, part string, bits string, conv string, u string, word string"


def clashing(df):
    """The frame with further columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    return df.withColumns({c.split()[0]: F.lit("own") for c in CLASHES.split(", ")})


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows and clashing columns."""
    rng = random.Random(3)
    words = [f"w{rng.randrange(4000)}" for _ in range(60_000)]
    long_text = " ".join(words)
    rows = [
        (1, "a b c d", "en", "s", 7),
        (1, "a b c d", "en", "s", 7),
        (1, "another text of the same id", "en", "s", 27),
        (2, "a  b\tc\nd", None, None, None),
        (3, None, "en", "s", None),
        (4, "", "en", "s", 0),
        (5, " \n\t", "en", "s", 3),
        (None, "a b c d", "en", None, 7),
        (None, None, None, None, None),
        (6, long_text, "en", "s", len(long_text)),
        (7, long_text.replace("w17 ", "w18 "), "de", "t", len(long_text)),
        (8, "  A b C d ", "en", "s", 10),
        (9, "ßé ñ 漢字 \U0001f600 word", "es", "t", 15),
    ]
    return clashing(spark.createDataFrame(rows, DOCS)).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return clashing(spark.createDataFrame([], DOCS))


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(k, int(k % 3 > 0), int(k % 4 == 0)) for k in range(200)] + [(1, None, None), (None, 1, 1), (2, 0, 1)]
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
