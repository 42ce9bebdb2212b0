"""Shared by the tests of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

#: NULLs in every column, empty and blank texts, ties, repeated rows.
ODD_DOCS = [
    (1, "One two three. Four five six seven eight.\nNine ten eleven twelve thirteen.", "en", "a", 70),
    (1, "One two three. Four five six seven eight.\nNine ten eleven twelve thirteen.", "en", "a", 70),
    (2, None, "en", "a", None),
    (3, "", None, None, 0),
    (4, " \n\t ", "de", "b", 4),
    (None, "A text without an id, as long as some others are in this table.", "en", None, 60),
    (None, None, None, None, None),
    (5, "word " * 3000, "en", "b", 15000),
    (6, "One two three. Four five six seven eight.\nNine ten eleven twelve thirteen.", "fr", "c", 70),
    (7, "▁ \x00 ￿ 😀 日本語 ñandú", "es", "c", 20),
]


def odd(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ODD_DOCS, DOC_SCHEMA).repartition(3)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], DOC_SCHEMA)


def clashing(df: DataFrame, *names: str) -> DataFrame:
    """More columns, named as an operator's own."""
    from pyspark.sql import functions as F
    return df.withColumns({n: F.lit("theirs") for n in names})
