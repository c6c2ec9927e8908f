import pytest
from pyspark.sql import types as T

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture()
def make(spark):
    """Documents of (doc_id, text) pairs, with columns whose names clash with those of results."""

    def build(rows, clash=()):
        data = [(i, t, "en", f"src{(i or 0) % 3}", len(t or ""), *["x"] * len(clash)) for i, t in rows]
        schema = T.StructType([*T._parse_datatype_string(SCHEMA).fields, *[T.StructField(c, T.StringType()) for c in clash]])
        return spark.createDataFrame(data, schema)

    return build
