import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])


@pytest.fixture(scope="session")
def documents(spark):
    """A function: rows of documents from texts (or (id, text, lang)), with two columns whose names clash with results."""

    def make(texts, partitions=3):
        rows = []
        for i, t in enumerate(texts):
            doc_id, text, lang = t if isinstance(t, tuple) else (i, t, "en")
            rows.append((doc_id, text, lang, "s", None if text is None else len(text)))
        return spark.createDataFrame(rows, SCHEMA).repartition(partitions)

    return make
