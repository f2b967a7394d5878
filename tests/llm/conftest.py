import pytest

EDGES = [
    (None, "lost words without an id"), (9001, None), (9002, ""), (9003, " \t\n"), (9004, "one"), (9005, "One"), (9006, "a b c d e"),
    (9007, "A b c d e"), (9008, "!!! ??? 123"), (9009, "same line\nsame line\nsame line"), (9010, "x" * 5000), (9011, "x" * 5000),
    (9012, "word " * 3000), (9013, "word " * 3000), (9014, "naïve déjà vu <|endoftext|> 漢字 ½ \u0085 don't \x1c end"), (9015, "é ΑΣ İ <|startoftext|>"),
]


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    """The smallest documents and edge cases, with extra columns that clash with names used inside."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    edges = spark.createDataFrame([(d, t, None, None, None) for d, t in EDGES], docs.schema)
    return docs.unionByName(edges).withColumn("node", F.lit("n")).withColumn("lo", F.lit(1)).withColumn("_cut", F.lit(2)).withColumn("size", F.lit(3)).cache()


@pytest.fixture(scope="session")
def texts(documents):
    return [(r[0], r[1]) for r in documents.select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def known(texts):
    return [(d, t) for d, t in texts if d is not None]


@pytest.fixture(scope="session")
def nothing(documents):
    return documents.limit(0)


@pytest.fixture
def few(spark):
    """A table of (doc_id, text) rows."""
    return lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
