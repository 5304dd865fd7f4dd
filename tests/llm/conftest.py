import pytest


@pytest.fixture(scope="session")
def texts(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    return {r.doc_id: r.text for r in rows}


@pytest.fixture
def odd(spark):
    """Null, empty, blank and repeated rows, a null id, columns whose names clash with results."""
    line = "the quick brown fox jumps over the lazy dog and runs through the dark wood at night "
    return spark.createDataFrame(
        [(1, line * 4, "a", "x"), (2, line * 4, "a", "x"), (2, line * 4, "a", "x"), (3, None, None, "x"), (4, "", "b", None),
         (5, " \n\t ", "b", "x"), (None, line, "c", "x"), (6, "one two", "c", "x"), (7, "ONE  two\n", "c", "x"), (8, "x" * 5000, "c", "x")],
        "doc_id long, text string, source string, quality string")


@pytest.fixture
def none(odd):
    return odd.where("doc_id = -1")
