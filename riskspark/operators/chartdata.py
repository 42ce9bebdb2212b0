"""Chart-ready tables (C1-C5, R4-R6).  The reference draws five charts; we
produce the tables behind them, each bounded no matter how large the input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskspark.operators.profile import group_counts, share


def top_features(importances: DataFrame, n: int = 10) -> DataFrame:
    """C1 / C2 (R4 + R5): (rank, feature, importance), largest first, ties
    by name.  A top-n (per-partition top n, then one merge of n rows per
    partition) comes first; ranks are numbered over those n rows only."""
    order = [F.desc("importance"), F.asc("feature")]
    top = importances.select("feature", "importance").orderBy(*order).limit(n)
    return (top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
            .select("rank", "feature", "importance"))


def scatter_cells(points: DataFrame, bins: int = 100, cluster: str = "cluster", x: str = "pca_x",
                  y: str = "pca_y") -> DataFrame:
    """C3 points: counts per (cluster, grid cell) on a ``bins`` x ``bins``
    grid spanning the points; each cell is drawn at its centre.  One
    aggregate finds the extent, so the table has at most
    clusters x bins^2 rows, whatever the row count."""
    ext = points.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1")).first()
    if ext["x0"] is None:
        x0 = y0 = 0.0
        wx = wy = 1.0
    else:
        x0, y0 = float(ext["x0"]), float(ext["y0"])
        wx = (float(ext["x1"]) - x0) / bins or 1.0
        wy = (float(ext["y1"]) - y0) / bins or 1.0
    cx = F.least(F.floor((F.col(x) - F.lit(x0)) / F.lit(wx)), F.lit(bins - 1))
    cy = F.least(F.floor((F.col(y) - F.lit(y0)) / F.lit(wy)), F.lit(bins - 1))
    return (points.groupBy(F.col(cluster).alias("cluster"), cx.alias("cell_x"), cy.alias("cell_y"))
            .agg(F.count(F.lit(1)).alias("n"))
            .withColumn("pca_x", F.lit(x0) + (F.col("cell_x") + 0.5) * F.lit(wx))
            .withColumn("pca_y", F.lit(y0) + (F.col("cell_y") + 0.5) * F.lit(wy))
            .withColumn("is_center", F.lit(False)))


def sample_points(points: DataFrame, key: Column, n: int = 1000, cluster: str = "cluster") -> DataFrame:
    """C3 points themselves: of each cluster the ``n`` points whose keys have the least md5 (a bottom-k sample: it
    doesn't depend on partitions, and samples of parts merge into the sample of the whole).

    A task sends at most n rows of a cluster on (Spark limits row numbers before the shuffle); keys that are
    equal are ordered by the other columns."""
    order = Window.partitionBy(cluster).orderBy(F.md5(key.cast("string")), *[F.col(f"`{c}`") for c in points.columns])
    return points.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def cluster_scatter(points: DataFrame, centers_xy: DataFrame, bins: int = 100) -> DataFrame:
    """Binned points plus the k projected centres (is_center = true)."""
    cells = scatter_cells(points, bins)
    cents = centers_xy.select(
        F.col("cluster"), F.lit(None).cast("bigint").alias("cell_x"), F.lit(None).cast("bigint").alias("cell_y"),
        F.lit(None).cast("bigint").alias("n"), "pca_x", "pca_y", F.lit(True).alias("is_center"))
    return cells.unionByName(cents)


def severity_share(df: DataFrame, label: str) -> DataFrame:
    """C4: label, n, pct of the cleaned table."""
    return share(df, label)


def cluster_sizes(assigned: DataFrame, prediction: str = "prediction") -> DataFrame:
    """(cluster, n) ordered by cluster."""
    return group_counts(assigned, prediction, "cluster")
