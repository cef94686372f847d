import pytest
from pyspark.sql import functions as F

from keyscape.llm.queries import prepare

CLASHES = ["i", "h", "t", "w", "n", "a", "b", "slot", "score", "uid", "unit", "n_tokens", "text_h", "anchor"]


@pytest.fixture(autouse=True)
def workers(spark):
    prepare(spark)


@pytest.fixture
def documents(spark):
    """Rows (doc_id, text[, source]) as a table with further columns of odd names."""

    def make(rows, schema="doc_id long, text string"):
        df = spark.createDataFrame(rows, schema)
        for c in CLASHES:
            df = df.withColumn(c, F.lit("x"))
        return df.repartition(3)

    return make
