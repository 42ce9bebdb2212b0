"""Distributed string encoding (E1, E2): value dictionaries as tables.

``StringIndexer`` gathers every distinct value on the driver and sends the
list to all tasks, which ends with columns of many values.  Here a dictionary is a table
(column_name, value, n, idx): values ranked by count descending, then value, and
rows are encoded by a join.  No list of values reaches the driver, and no task
ranks a whole column:

1. (column, value) counts, combined on the map side;
2. the counts are dealt out by ranges of (column, count descending, value) and sorted within
   the partitions, so a value's place in its partition is known there;
3. the partitions' sizes are summed per column (a row per partition and column)
   and added to the places.

Ranges are cut by sampled bounds, so equal counts (a near-unique column has one
count only) are split by value."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskspark.session import cut_lineage

#: A dictionary column of at most this many values and bytes of values is broadcast, else joined by a shuffle.
BROADCAST_VALUES = 100_000
BROADCAST_BYTES = 16 << 20

HANDLING = ("error", "keep", "skip")


def fit_dictionary(train: DataFrame, cols: list[str]) -> DataFrame:
    """(column_name, value, n, idx): idx counts from 0 by (n descending, value); missing values are left out.

    The table is written to the shared folder: several encodings may read it."""
    if not cols:
        return train.sparkSession.createDataFrame([], "column_name string, value string, n bigint, idx bigint")
    entries = [F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("value")) for c in cols]
    counts = (train.select(F.explode(F.array(*entries)).alias("e")).select("e.*").where(F.col("value").isNotNull())
              .groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n")))
    order = ["column_name", F.col("n").desc(), "value"]
    dealt = counts.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = cut_lineage(dealt.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place")))
    sizes = dealt.groupBy("column_name", "part").agg(F.count(F.lit(1)).alias("here"), F.min("place").alias("first"))
    earlier = Window.partitionBy("column_name").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("column_name", "part", "first", F.coalesce(F.sum("here").over(earlier), F.lit(0)).alias("before"))
    # Ranges are sorted by column: at most one row for each partition and each column.
    ranked = dealt.join(F.broadcast(sizes), ["column_name", "part"])
    return cut_lineage(ranked.select("column_name", "value", "n", (F.col("before") + F.col("place") - F.col("first")).alias("idx")))


def dictionary_sizes(dictionary: DataFrame) -> dict[str, tuple[int, int]]:
    """(values, bytes of values) of each column: one row per column."""
    rows = dictionary.groupBy("column_name").agg(F.count(F.lit(1)).alias("n"),
                                                 F.sum(F.octet_length("value")).alias("bytes")).collect()
    return {r["column_name"]: (r["n"], r["bytes"]) for r in rows}


def _free_name(df: DataFrame, name: str) -> str:
    while name in df.columns:
        name += "_"
    return name


def encode(df: DataFrame, dictionary: DataFrame, cols: dict[str, str], handle_invalid: str = "error",
           broadcast_values: int = BROADCAST_VALUES, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Adds an index column (double) for each column of ``cols`` {column: index column}.

    Values without an entry and missing values fail the job that meets them ('error'), get the number of
    values as their index ('keep'), or their rows go ('skip').  A dictionary column over the
    bounds is joined by a shuffle of the rows; a value that a large share of rows has is then one
    skewed key of the rows' side, which adaptive execution splits."""
    if handle_invalid not in HANDLING:
        raise ValueError(f"handle_invalid is one of {HANDLING}")
    sizes = dictionary_sizes(dictionary)
    for col, out in cols.items():
        values, size = sizes.get(col, (0, 0))
        key, found = _free_name(df, "dictionary_value"), _free_name(df, "dictionary_index")
        entries = dictionary.where(F.col("column_name") == col).select(F.col("value").alias(key), F.col("idx").alias(found))
        if values <= broadcast_values and size <= broadcast_bytes:
            entries = F.broadcast(entries)
        joined = df.join(entries, F.col(f"`{col}`").cast("string") == F.col(key), "left")
        if handle_invalid == "skip":
            joined = joined.where(F.col(found).isNotNull())
            index = F.col(found)
        elif handle_invalid == "keep":
            index = F.coalesce(found, F.lit(values))
        else:
            says = F.concat(F.lit(f"column {col} has no index for "), F.coalesce(F.col(f"`{col}`").cast("string"), F.lit("NULL")))
            index = F.coalesce(found, F.raise_error(says).cast("bigint"))
        df = joined.withColumn(out, index.cast("double")).drop(key, found)
    return df
