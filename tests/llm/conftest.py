import pytest

from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_words", T.StringType()), T.StructField("score", T.StringType()),
])


@pytest.fixture
def docs(spark):
    """Documents with columns whose names clash with those that operators add."""

    def make(rows):
        full = [(i, t, "en", "s", "own", "own") for i, t in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture
def awkward(docs):
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(40_000))
    return docs([
        (1, None), (2, ""), (3, " \t\n "), (None, "a text without an id " * 20), (4, "same row"), (4, "same row"),
        (5, "été 中文 x <|endoftext|> it's  done"), (6, long), (7, long), (8, "z" * 50_000), (9, "a"),
    ])


@pytest.fixture(scope="session")
def table():
    import pyarrow.parquet as pq

    return lambda name, folder="/root/testdata/sf0.001": pq.read_table(f"{folder}/{name}.parquet").to_pylist()
