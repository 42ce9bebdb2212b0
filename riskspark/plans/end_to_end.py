"""The whole flow from a CSV file to written report tables: profile, clean,
multiclass forest, binary forest, clustering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from riskspark.operators import chartdata, evaluate, models, profile
from riskspark.operators.clean import fit_cleaning
from riskspark.plans import analyses
from riskspark.roles import Roles
from riskspark.sources.readers import read_csv
from riskspark.sources.sinks import write_reports


def run(spark: SparkSession, csv_path: str, out_dir: str, roles: Roles = Roles(),
        schema: T.StructType | str | None = None, params: models.ForestParams = models.ForestParams(),
        partitions: int | None = None, multi_line: bool = False, **prepare_options) -> list[str]:
    """Write one table per report under ``out_dir`` and return their paths.

    Without a ``schema`` column types are inferred; ``prepare_options`` are those of ``analyses.prepare``.  Without a
    ``date_format`` the one that reads every date is found."""
    if prepare_options.get("clean", True):
        prepare_options.setdefault("date_format", "infer")
    raw = read_csv(spark, csv_path, schema=schema, roles=roles, infer=schema is None, multi_line=multi_line)
    reports: dict[str, DataFrame] = {
        "column_profile": profile.column_profile(raw, with_total=True),
        "duplicate_rows": profile.duplicate_rows(raw),
        "label_counts": profile.value_counts(raw, roles.label),
    }
    prep = analyses.prepare(raw, roles, partitions=partitions, **prepare_options)
    try:
        labels = raw.select(roles.label)
        only_label = Roles(id=None, label=roles.label, date=None, time=None)
        filled = fit_cleaning(labels, only_label, parts=("fill",)).transform(labels)
        reports["severity_share"] = chartdata.severity_share(filled, roles.label)
        if prep.cleaning is not None:
            reports["fills"] = prep.cleaning.fills_frame(spark)
            reports["bounds"] = prep.cleaning.bounds_frame(spark)
        reports["split_counts"] = profile.group_counts(prep.data, "split")

        multi = analyses.multiclass_report(prep, params)
        reports["multiclass_metrics"], reports["multiclass_top_features"] = multi["metrics"], multi["top_features"]
        reports["confusion"] = evaluate.confusion(multi["model"].transform(prep.test), prep.label_index)
        binary = analyses.binary_report(prep, params)
        reports["binary_metrics"], reports["binary_top_features"] = binary["metrics"], binary["top_features"]
        reports["binary_label_counts"] = binary["label_counts"]

        clusters = analyses.Clustering(prep.data, [roles.id] if roles.id else [], partitions=partitions)
        try:
            reports |= {"cluster_sizes": clusters.sizes(), "cluster_centers": clusters.centers(),
                        "explained_variance": clusters.explained(), "scatter": clusters.scatter()}
            return write_reports(reports, out_dir)      # while the cached vectors are there
        finally:
            clusters.release()
    finally:
        prep.release()
