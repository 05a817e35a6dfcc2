from __future__ import annotations

import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text) or longer tuples, over several partitions."""

    def make(rows, parts=3):
        full = [(*r, *("en", "s", None)[len(r) - 2 :])[:5] if len(r) < 5 else r for r in rows]
        return spark.createDataFrame(full, DOCS).repartition(parts)

    return make
