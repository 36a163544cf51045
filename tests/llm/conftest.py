import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from llm_fixtures import CLASHES, EDGE  # noqa: E402


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, clashing extra columns."""
    df = spark.createDataFrame([(*r, "en", None, None) for r in EDGE], "doc_id long, text string, lang string, source string, n_chars long")
    for i, name in enumerate(CLASHES):
        df = df.withColumn(name, F.lit(i) if i % 2 else F.lit("x"))
    return df


@pytest.fixture(scope="session")
def nothing(edge):
    return edge.limit(0)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
