import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, id string, k int, kept boolean"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in all columns, empty and very long texts, ties, repeated rows, and columns that clash with results."""
    base = "the quick brown fox jumps over the lazy dog and runs away from all the other animals of the wood at night "
    rows = [
        (1, base * 3, "en", "a", 9, 0.5, "x", 1, True),
        (1, base * 3, "en", "a", 9, 0.5, "x", 1, True),  # a repeated row
        (2, base * 3, "en", "b", 9, 0.5, "x", 1, False),  # the same text
        (3, None, None, None, None, None, None, None, None),
        (4, "", "en", "a", 0, 0.1, "", 0, None),
        (5, " \t\n", "de", "b", 3, 0.1, "", 0, None),
        (6, "1234 !!! ???", "de", "b", 3, 0.1, "", 0, None),
        (7, (base + "Licensed under the Apache License, Version 2.0. ") * 4000, "en", "a", 5, 0.2, "y", 2, None),
        (8, "der schnelle braune Fuchs und die faulen Hunde im Wald bei Nacht " * 4, "de", "b", 5, 0.2, "y", 2, None),
        (None, "a row without an id but with words of its own", "en", None, 5, 0.2, "y", 2, None),
        (9, "un", None, "c", 2, None, None, None, None),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (8, 1, 0), (6, 0, 0), (None, 1, 0), (2, None, None), (8, 1, None)], "doc_id long, quality int, toxic int")
