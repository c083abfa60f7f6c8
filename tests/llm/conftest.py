import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty and long texts, repeated rows, and columns whose names clash with those inside the operators."""
    words = "the lazy dog of the house and the bridge over the river were there again today"
    long = "\n".join(f"{words} number {i}" for i in range(3000))
    rows = [
        (1, words, "en", "a", 5), (1, words, "en", "a", 5), (2, None, "en", None, None), (3, "", None, "a", 0), (4, long, "en", "b", None),
        (None, words + " more", None, "b", 1), (None, None, None, None, None), (5, "x", "de", None, 1), (6, " \n\t ", "de", "c", 4),
        (7, "%%% 123 ***", "en", "c", 11), (8, long, "en", "b", 7), (9, words.upper(), "en", "c", 3),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("size", "fp", "body", "a", "b", "place", "held_out", "component_id", "rep", "nth", "shard", "line", "at"):
        df = df.withColumn(name, F.lit(f"clash {name}"))
    return df


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.limit(0)
