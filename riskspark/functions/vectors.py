"""Vector helpers: vector <-> array, and vector elements as plain columns."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def vector_element(c: str | Column, i: int) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return vector_to_array(col)[i]


def vector_columns(df: DataFrame, vec: str, names: list[str], keep: list[str]) -> DataFrame:
    """Spread a vector column into one double column per element."""
    arr = vector_to_array(F.col(vec))
    return df.select(*keep, *[arr[i].alias(n) for i, n in enumerate(names)])


def to_vector(c: str | Column) -> Column:
    """array<float|double> -> dense ml vector."""
    col = F.col(c) if isinstance(c, str) else c
    return array_to_vector(col.cast("array<double>"))
