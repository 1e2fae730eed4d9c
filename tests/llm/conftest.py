import pytest
from pyspark.sql import functions as F

from tests.llm.cases import ROWS, SCHEMA


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, and extra columns whose names operators may want."""
    docs = spark.createDataFrame(ROWS, SCHEMA)
    extra = ["digest", "score", "key", "row", "rank", "lines", "ids", "finish", "winner", "document", "gone", "found"]
    return docs.withColumns({name: F.lit(name) for name in extra})


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def some_docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
