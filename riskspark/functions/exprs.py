"""Column expressions shared by the operators.  All are built-in Spark
expressions, so they stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Peak hours are 7 to 9 and 17 to 19, both ends included.
PEAK_HOUR_RANGES = ((7, 9), (17, 19))

# Fixed value: clip bounds are Q1 - 3*IQR and Q3 + 3*IQR.
IQR_FACTOR = 3.0

# Hash split: the first six hex digits of md5(id as text) give a bucket in
# [0, 16^6); a row is in the training part when bucket < fraction * 16^6.
HASH_DIGITS = 6
HASH_SPACE = 16 ** HASH_DIGITS


def nan_to_null(c: Column) -> Column:
    """NaN becomes NULL, so statistics skip it (pandas treats NaN as missing)."""
    return F.when(~F.isnan(c), c)


def missing(c: Column, floating: bool) -> Column:
    """True where the value is missing: NULL, or NaN for floating columns."""
    return (c.isNull() | F.isnan(c)) if floating else c.isNull()


def clip(c: Column, lo: float, hi: float) -> Column:
    """Clip to [lo, hi] in double precision; NULL and NaN stay as they are.

    (``least``/``greatest`` skip NULLs, which would turn NULL into a bound.)"""
    x = c.cast("double")
    return (F.when(F.isnan(x), x)
            .when(x < F.lit(float(lo)), F.lit(float(lo)))
            .when(x > F.lit(float(hi)), F.lit(float(hi)))
            .otherwise(x))


def peak_hour(hour: Column) -> Column:
    """1 when the hour is in a peak range (ends included), else 0."""
    cond = None
    for lo, hi in PEAK_HOUR_RANGES:
        part = hour.between(lo, hi)
        cond = part if cond is None else (cond | part)
    return cond.cast("int")


def hash_bucket(key: Column) -> Column:
    """Deterministic bucket in [0, 16^6) from md5 of the key's text form."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, HASH_DIGITS), 16, 10).cast("bigint")


def in_train(key: Column, fraction: float) -> Column:
    return hash_bucket(key) < F.lit(fraction * HASH_SPACE)


def composite_key(*cols: str) -> Column:
    """Text key made of several columns joined by '|' (for tables without an id)."""
    return F.concat_ws("|", *[F.col(c).cast("string") for c in cols])


def round_half_up(c: Column, digits: int) -> Column:
    """Round half up computed in double: floor(x * 10^d + 0.5) / 10^d.

    Written as plain IEEE arithmetic so another engine running the same
    formula gets the same bits (Spark's ``round`` goes through decimals)."""
    scale = float(10 ** digits)
    return (F.floor(c.cast("double") * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale))


def sql_round_half_up(expr: str, digits: int) -> str:
    """The same rounding as ``round_half_up`` written as SQL text (for oracles)."""
    scale = float(10 ** digits)
    return f"(CAST(floor(CAST({expr} AS DOUBLE) * {scale!r} + 0.5) AS DOUBLE) / {scale!r})"
