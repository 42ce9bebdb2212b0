"""Profiling (P1-P8).  Each report is a DataFrame; all column-wise numbers
come from one aggregate over all columns at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskspark.functions.columns import is_floating
from riskspark.functions.exprs import missing, round_half_up
from riskspark.session import cut_lineage


def _missing_expr(df: DataFrame, name: str) -> Column:
    f = df.schema[name]
    if isinstance(f.dataType, T.AtomicType):
        return missing(F.col(name), is_floating(f.dataType))
    return F.col(name).isNull()


def column_profile(df: DataFrame, with_total: bool = False) -> DataFrame:
    """P1 + P3: one row per column (pos, column_name, dtype, non_null, missing).

    ``missing`` counts NULL and, for float columns, NaN (as pandas does);
    ``non_null`` is rows - missing.  ``with_total`` appends a row
    (pos = -1, column_name = '*') holding the total of missing values."""
    fields = df.schema.fields
    aggs = [F.count(F.lit(1)).alias("rows")]
    aggs += [F.count(F.when(_missing_expr(df, f.name), True)).alias(f"m{i}") for i, f in enumerate(fields)]
    one = df.agg(*aggs)
    items = [F.struct(F.lit(i).alias("pos"), F.lit(f.name).alias("column_name"),
                      F.lit(f.dataType.simpleString()).alias("dtype"),
                      (F.col("rows") - F.col(f"m{i}")).alias("non_null"),
                      F.col(f"m{i}").alias("missing"))
             for i, f in enumerate(fields)]
    if with_total:
        total = sum((F.col(f"m{i}") for i in range(len(fields))), F.lit(0).cast("bigint"))
        items.append(F.struct(F.lit(-1).alias("pos"), F.lit("*").alias("column_name"),
                              F.lit(None).cast("string").alias("dtype"),
                              F.lit(None).cast("bigint").alias("non_null"), total.alias("missing")))
    return one.select(F.inline(F.array(*items)))


def missing_total(df: DataFrame) -> DataFrame:
    """P3 alone: one row with the number of missing cells."""
    prof = column_profile(df)
    return prof.agg(F.coalesce(F.sum("missing"), F.lit(0)).cast("bigint").alias("missing_total"))


def duplicate_rows(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Rows equal to an earlier row (NULL equals NULL, as in pandas).

    A group-by on all columns; map-side combining keeps a hot row cheap."""
    cols = cols or df.columns
    groups = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("rows"),
        F.count(F.lit(1)).alias("distinct_rows"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("duplicate_rows"),
    )


#: Digests of repeated rows that may be broadcast (16 bytes each).
BROADCAST_DIGESTS = 500_000


def row_digest(df: DataFrame, cols: list[str]) -> Column:
    """128 bits that are equal for rows that grouping holds equal: NULL equals NULL, -0.0 equals 0.0, NaN equals NaN."""
    parts = []
    for c in cols:
        kind, x = df.schema[c].dataType, F.col(f"`{c}`")
        if is_floating(kind):
            x = x + F.lit(0.0)
        text = F.hex(x) if isinstance(kind, T.BinaryType) else x.cast("string") if isinstance(kind, T.AtomicType) else F.to_json(F.struct(x))
        parts.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("n")))
    return F.unhex(F.md5(F.concat(*parts)))


def duplicate_rows_by_digest(df: DataFrame, cols: list[str] | None = None, broadcast_digests: int = BROADCAST_DIGESTS) -> DataFrame:
    """P2, as ``duplicate_rows``, with slim shuffles: rows are counted by a digest of 16 bytes, and only rows whose digest
    occurs twice or more are compared themselves (two rows with one digest may still differ).

    Few repeated digests (a checked count) are broadcast, so that the other rows never leave their task."""
    cols = cols or df.columns
    rows = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(cols)], row_digest(df, cols).alias("digest"))
    counts = cut_lineage(rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n")))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count(F.when(F.col("n") == 1, 1)).alias("single"),
                       F.count(F.when(F.col("n") > 1, 1)).alias("again")).first()
    again = counts.where("n > 1").select("digest")
    if total["again"] <= broadcast_digests:
        again = F.broadcast(again)
    # Partial counts on the map side leave one row for each different row and task.
    groups = rows.join(again, "digest", "left_semi").groupBy("digest", *[f"c{i}" for i in range(len(cols))]).agg(F.lit(1).alias("one"))
    distinct = F.lit(total["single"]) + F.count(F.lit(1))
    return groups.agg(F.lit(total["rows"]).cast("bigint").alias("rows"), distinct.cast("bigint").alias("distinct_rows"),
                      (F.lit(total["rows"]) - distinct).cast("bigint").alias("duplicate_rows"))


def distinct_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column_name, n_distinct) per column, missing excluded.

    The (column, value) pairs of all columns go through one map-side
    combined group-by (a hot value is one partial row per task), then a
    second group-by counts the pairs per column.  No per-column Expand, and
    no task ever holds the distinct values of a column."""
    if not cols:
        return df.sparkSession.createDataFrame([], "column_name string, n_distinct bigint")
    entries = [F.struct(F.lit(c).alias("k"), F.col(c).cast("string").alias("v")) for c in cols]
    pairs = (df.select(F.explode(F.array(*entries)).alias("e")).select("e.*")
             .where(F.col("v").isNotNull())
             .distinct())
    found = pairs.groupBy(F.col("k").alias("column_name")).agg(F.count(F.lit(1)).alias("n_distinct"))
    names = df.sparkSession.createDataFrame([(c,) for c in cols], "column_name string")
    # Columns with no values at all still get a row (0); ``names`` has one
    # row per column, so this join is bounded by the column count.
    return (names.join(F.broadcast(found), "column_name", "left")
            .select("column_name", F.coalesce(F.col("n_distinct"), F.lit(0)).cast("bigint").alias("n_distinct")))


def value_counts(df: DataFrame, col: str, name: str = "label", dropna: bool = True) -> DataFrame:
    """Counts per value, missing excluded, most frequent first (ties by value)."""
    src = df.where(F.col(col).isNotNull()) if dropna else df
    return (src.groupBy(F.col(col).alias(name)).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), F.asc(name)))


def share(df: DataFrame, col: str, name: str = "label", digits: int = 1) -> DataFrame:
    """P5 / C4: counts per value with the percent share rounded to ``digits``.

    The total is a scalar subquery over the grouped counts (one value, no
    join); the grouped counts are one shuffle that both uses share, and no
    step gathers all groups into one task, however many values the column
    has."""
    counts = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias(name)).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return (counts.select(name, "n", round_half_up(F.lit(100.0) * F.col("n") / total, digits).alias("pct"))
            .orderBy(F.desc("n"), F.asc(name)))


def group_counts(df: DataFrame, col: str, name: str | None = None) -> DataFrame:
    """Rows per value of a small-arity column, ordered by value."""
    out = name or col
    return df.groupBy(F.col(col).alias(out)).agg(F.count(F.lit(1)).alias("n")).orderBy(out)
