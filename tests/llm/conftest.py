import pytest
from odd_rows import ODD


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows; extra columns whose names operators use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string")
    return df.select("*", *[F.lit(1).alias(n) for n in ("sha", "fp", "key", "lane", "h", "bucket", "at", "a", "cells", "digests", "words", "y", "score")]).repartition(3)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
