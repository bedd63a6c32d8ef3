import pytest
from pyspark.sql import types as T


@pytest.fixture
def rows(spark):
    """A table from rows and a DDL schema."""
    return lambda data, schema: spark.createDataFrame(data, schema)


@pytest.fixture
def docs(spark):
    """A documents table from (doc_id, text) or (doc_id, text, lang, source) rows, with columns that clash."""
    def build(data):
        full = [(d[0], d[1], d[2] if len(d) > 2 else "en", d[3] if len(d) > 3 else "s",
                 len(d[1] or ""), "x", 1, "y", b"z") for d in data]
        schema = ("doc_id long, text string, lang string, source string, n_chars long, id string, n long,"
                  " fingerprint string, block binary")
        return spark.createDataFrame(full, schema)

    return build


@pytest.fixture
def no_rows(spark):
    """The same table without rows."""
    return lambda df: spark.createDataFrame([], T.StructType(df.schema.fields))
