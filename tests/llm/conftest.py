import pytest

#: Rows that every operator has to bear: nulls, empty and white texts, a very long one, repeated rows and ids.
HARD = [
    (0, "one two three four five six seven eight nine ten", "en", "s", 1),
    (0, "one two three four five six seven eight nine ten", "en", "s", 1),
    (1, "ONE two  three four five six seven eight nine ten", None, None, None),
    (2, None, "en", None, 0),
    (3, "", None, "s", 0),
    (4, " \n\t ", "fr", "s", 0),
    (5, "word " * 40_000, "en", "s", 0),
    (6, "a" * 50_000, "en", "s", 0),
    (7, "é" * 20_000 + " \u00a0  漢字 ñ\u0000ul", "es", "s", 0),
    (None, "one two three four five six seven eight nine ten", "en", "s", 0),
    (None, None, None, None, None),
    (8, "tiny", "en", "s", 0),
    (8, "other text of the same id with some more words in it", "en", "s", 0),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def hard(spark):
    """HARD with extra columns whose names clash with what operators add."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(HARD, SCHEMA).repartition(3)
    return df.withColumns({"score": F.lit("mine"), "ids": F.lit(1), "_row": F.lit(2), "rep": F.lit(3), "word": F.lit("w"), "part": F.lit(4), "toxic": F.lit(9), "key": F.lit(5)})


@pytest.fixture(scope="session")
def empty(hard):
    return hard.limit(0)


@pytest.fixture(scope="session")
def sf():
    import os

    path = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(path):
        pytest.skip("no driver tables here")
    return path
