import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that operators use inside, to clash with
    T.StructField("id", T.StringType()), T.StructField("kept", T.StringType()), T.StructField("size", T.StringType()),
    T.StructField("label", T.StringType()), T.StructField("key", T.StringType())])


@pytest.fixture(scope="session")
def make_docs(spark):
    """documents with clashing extra columns, from (doc_id, text[, source]) rows."""
    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1]), "x", "x", "x", "x", "x")
                for r in rows]
        return spark.createDataFrame(full, DOCS)
    return make
