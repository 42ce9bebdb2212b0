"""Splitting and recombining.

The default split is a hash of the row id: the same rows land in the same
part whatever the partitioning, the number of executors or a retried task
(``randomSplit`` depends on partitioning; it stays available as an option).
It is a narrow filter: no shuffle, no sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.functions.exprs import composite_key, in_train


def _key(df: DataFrame, key: str | list[str] | Column) -> Column:
    if isinstance(key, Column):
        return key
    if isinstance(key, str):
        return F.col(key)
    return composite_key(*key)


def with_split(df: DataFrame, key: str | list[str] | Column, fraction: float = 0.8,
               name: str = "split") -> DataFrame:
    """Add a 'train' / 'test' column from the hash of ``key``."""
    return df.withColumn(name, F.when(in_train(_key(df, key), fraction), F.lit("train")).otherwise(F.lit("test")))


def hash_split(df: DataFrame, key: str | list[str] | Column, fraction: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(train, test) by hash of the id; deterministic and partition-independent.
    A row whose key is NULL goes to the test part (it is never dropped)."""
    cond = F.coalesce(in_train(_key(df, key), fraction), F.lit(False))
    return df.where(cond), df.where(~cond)


def random_split(df: DataFrame, fraction: float = 0.8, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """R1 as the reference wrote it (``randomSplit``); depends on partitioning."""
    train, test = df.randomSplit([fraction, 1.0 - fraction], seed=seed)
    return train, test


def union_parts(*parts: DataFrame) -> DataFrame:
    """R2: bag union by column name (duplicates kept)."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def spread(df: DataFrame, partitions: int | None = None, *cols: str) -> DataFrame:
    """Repartition.  With no count this is a REBALANCE: AQE sizes the
    partitions at run time (and splits skewed ones) instead of a fixed number."""
    if partitions is None:
        return df.hint("rebalance", *cols)
    return df.repartition(partitions, *cols)


#: Most rows of a partition that a fit keeps: of 500,000 bagged for 30 trees a task reads about 100 MB.
DEALT_ROWS = 500_000


def enough_partitions(df: DataFrame, least: int) -> int:
    """``least``, or as many partitions as hold ``DEALT_ROWS`` rows each, so that a task's share does
    not grow with the table.  The number follows from the rows alone, and the count reads no column."""
    return max(least, -(-df.count() // DEALT_ROWS))
