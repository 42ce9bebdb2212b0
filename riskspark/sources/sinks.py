"""Sinks: reports and chart-ready tables are DataFrames written with
``df.write`` (S5, S7); charts themselves are drawn by whoever reads them."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: list[str] | None = None) -> None:
    writer = df.write.mode(mode).format(fmt)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def write_reports(reports: dict[str, DataFrame], folder: str, fmt: str = "parquet") -> list[str]:
    """Write each named report table under ``folder/<name>``."""
    paths = []
    for name, df in reports.items():
        path = f"{folder.rstrip('/')}/{name}"
        write_table(df, path, fmt=fmt)
        paths.append(path)
    return paths
