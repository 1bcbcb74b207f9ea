import pytest
from pyspark.sql import types as T

DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def docs_of(spark):
    """Makes a documents table of (doc_id, text[, lang]) rows."""

    def make(rows):
        return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1]) if r[1] else 0) for r in rows], DOC)

    return make


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").cache()


#: Texts that every operator must bear.
ODD = [None, "", " ", "\n\n", "a", "...", "\t  x", "\U0001f9ff日本", "x" * 300_000, ("word " * 40_000).strip(), "same text here twice", "same text here twice"]


@pytest.fixture(scope="session")
def odd(docs_of):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "a row without an id"), (10, ODD[10])]
    return docs_of(rows)


@pytest.fixture(scope="session")
def clash(spark, odd):
    """The odd rows with further columns whose names operators use inside."""
    from pyspark.sql import functions as F

    names = ["_row", "_hit", "_doc", "_gone", "_lines", "_text", "text2", "doc", "rid", "k1", "words", "id", "component", "rn", "k"]
    return odd.select("*", *(F.lit(i).alias(n) for i, n in enumerate(names)))


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
