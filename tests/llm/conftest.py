from __future__ import annotations

import pytest
from pyspark.sql import types as T

from shelfwise.llm.shipping import ship

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


@pytest.fixture(scope="session")
def documents(spark):
    """A documents table from (doc_id, text) pairs."""
    ship(spark)

    def build(rows, **more):
        full = [(i, t, "en", f"src{k % 3}", None if t is None else len(t)) for k, (i, t) in enumerate(rows)]
        frame = spark.createDataFrame(full, DOCUMENTS)
        for name, value in more.items():
            frame = frame.withColumn(name, value)
        return frame

    return build


@pytest.fixture(scope="session")
def clashing():
    """Column names that operators use inside, to be carried by an input table."""
    return ["key", "row", "segment", "part", "block", "label", "component", "score", "weight", "value", "tokens"]
