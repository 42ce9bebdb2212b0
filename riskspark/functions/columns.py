"""Choose columns by type and by role (metadata only, no Spark job)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Spark simple-type names the reference keeps as features when
# ``feature_types`` is given (its own filter is int and double).
REFERENCE_FEATURE_TYPES = ("int", "double")


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_floating(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType))


def is_atomic(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.AtomicType)


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema.fields if is_numeric(f.dataType) and f.name not in skip]


def string_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.StringType) and f.name not in skip]


def other_atomic_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    """Non-numeric atomic columns (string, boolean, date, timestamp)."""
    skip = set(exclude)
    return [f.name for f in df.schema.fields
            if is_atomic(f.dataType) and not is_numeric(f.dataType) and f.name not in skip]


def columns_of_types(df: DataFrame, type_names: Iterable[str],
                     exclude: Iterable[str] = ()) -> list[str]:
    """Columns whose ``simpleString`` type is in ``type_names`` (e.g. 'int', 'double')."""
    wanted = set(type_names)
    skip = set(exclude)
    return [f.name for f in df.schema.fields
            if f.dataType.simpleString() in wanted and f.name not in skip]
