from __future__ import annotations

import pytest
from pyspark.sql import DataFrame, SparkSession

#: Nulls, empty and blank texts, repeated rows, equal texts, a clashing column on every row.
ODD = [
    (1, "The quick brown fox jumps over the lazy dog", "en", "src0", 43), (1, "The quick brown fox jumps over the lazy dog", "en", "src0", 43), (2, None, "en", "src0", None), (3, "", None, None, 0),
    (4, " \n\t ", "de", "src1", 4), (5, "The quick brown fox jumps over the lazy dog", "en", None, 43), (None, "no id here at all", "en", "src1", 17), (6, "x", "fr", "", 1), (7, "word " * 30_000, "en", "src0", 150_000),
]


@pytest.fixture(scope="session")
def odd(spark: SparkSession) -> DataFrame:
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long")
    clash = {c: F.lit("clash") for c in ("shard", "slot", "bucket", "score", "predicted", "host", "path", "taken", "size", "fp", "component_id", "key", "value", "start", "parts", "row", "__id", "__row", "__text", "__normal", "__order", "__many", "__src", "__hash", "___id")}
    return rows.withColumns(clash)


@pytest.fixture(scope="session")
def none(odd: DataFrame) -> DataFrame:
    return odd.where("false")
