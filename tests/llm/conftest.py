import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    T.StructField("key", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("size", T.LongType()),
])


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text[, source[, lang]]), with columns whose names operators use themselves."""
    def make(rows):
        full = []
        for row in rows:
            doc_id, text, source, lang = (*row, None, None)[:4]
            full.append((doc_id, text, lang, source, len(text) if text is not None else None, "k", 1.5, 7))
        return spark.createDataFrame(full, DOCS)

    return make
