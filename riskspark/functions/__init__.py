"""Column-level helpers: type selection, expressions, vector access."""

from riskspark.functions.columns import (
    columns_of_types,
    is_floating,
    is_numeric,
    numeric_columns,
    other_atomic_columns,
    string_columns,
)
from riskspark.functions.exprs import (
    clip,
    composite_key,
    hash_bucket,
    in_train,
    missing,
    nan_to_null,
    peak_hour,
    round_half_up,
)
from riskspark.functions.vectors import to_vector, vector_columns, vector_element

__all__ = [
    "clip", "columns_of_types", "composite_key", "hash_bucket", "in_train",
    "is_floating", "is_numeric", "missing", "nan_to_null", "numeric_columns",
    "other_atomic_columns", "peak_hour", "round_half_up", "string_columns",
    "to_vector", "vector_columns", "vector_element",
]
