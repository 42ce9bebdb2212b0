"""Random forests (M1-M5) on MLlib.

MLlib grows the trees level by level with distributed histogram
aggregation; the driver only holds the trees.  The reference's settings are
the defaults here; ``cache_node_ids`` plus a checkpoint interval (written to
the session's shared checkpoint folder) is the option for deep forests.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.sql import DataFrame, SparkSession

from riskspark.session import checkpoint_dir


@dataclass(frozen=True)
class ForestParams:
    # Fixed values of the reference's forests.
    num_trees: int = 30
    max_depth: int = 4
    impurity: str = "gini"
    feature_subset: str = "sqrt"
    seed: int = 42
    # MLlib defaults the reference leaves unset.
    max_bins: int = 32
    bootstrap: bool = True
    subsampling_rate: float = 1.0
    min_instances_per_node: int = 1
    cache_node_ids: bool = False
    checkpoint_interval: int = 10


class ArityError(ValueError):
    """A categorical feature has more values than the trees have bins."""


def check_arity(train: DataFrame, features: str, max_bins: int) -> None:
    """Read from the vector's metadata, before any job runs."""
    attrs = train.schema[features].metadata.get("ml_attr", {}).get("attrs", {}).get("nominal", [])
    bad = {a.get("name", a["idx"]): len(a["vals"]) for a in attrs if len(a.get("vals", ())) > max_bins}
    if bad:
        raise ArityError(f"categorical features have more values than max_bins={max_bins}: {bad}")


def fit_forest(train: DataFrame, label: str, features: str = "features",
               params: ForestParams = ForestParams()) -> RandomForestClassificationModel:
    """M1 / M3: fit a random-forest classifier."""
    check_arity(train, features, params.max_bins)
    if params.cache_node_ids:
        checkpoint_dir(train.sparkSession)
    rf = RandomForestClassifier(
        labelCol=label, featuresCol=features, numTrees=params.num_trees, maxDepth=params.max_depth,
        impurity=params.impurity, featureSubsetStrategy=params.feature_subset, seed=params.seed,
        maxBins=params.max_bins, bootstrap=params.bootstrap, subsamplingRate=params.subsampling_rate,
        minInstancesPerNode=params.min_instances_per_node, cacheNodeIds=params.cache_node_ids,
        checkpointInterval=params.checkpoint_interval,
    )
    return rf.fit(train)


def importance_frame(spark: SparkSession, model: RandomForestClassificationModel,
                     names: list[str]) -> DataFrame:
    """M5: (pos, feature, importance); importances sum to 1, one row per
    feature (bounded by the feature count)."""
    values = model.featureImportances.toArray().tolist()
    rows = [(i, n, float(v)) for i, (n, v) in enumerate(zip(names, values))]
    return spark.createDataFrame(rows, "pos int, feature string, importance double")


_SPLIT = re.compile(r"If \(feature (\d+) <= ([-+0-9.eE]+)\)")


def root_split(model, tree: int = 0) -> tuple[int, float] | None:
    """(feature index, threshold) of a tree's root split on a continuous
    feature, read from the model's public debug text; None for a leaf."""
    text = model.trees[tree].toDebugString
    m = _SPLIT.search(text)
    return (int(m.group(1)), float(m.group(2))) if m else None
