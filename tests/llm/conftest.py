import pytest

from pyspark.sql import types as T


@pytest.fixture
def make(spark):
    """Documents of (doc_id, text) or (doc_id, text, source); an extra column has a name that operators use."""

    def build(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "a", len(r[1] or ""), 7) for r in rows]
        schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("size", T.IntegerType())])
        return spark.createDataFrame(full, schema)

    return build
