"""The reference's three analyses, as composable plans.

``prepare``: clean (statistics from all rows) -> hash split -> encoders and
label index fitted on train -> feature list -> vectors.  Then
``multiclass_report`` (forest + accuracy/F1 + importances),
``binary_report`` (not-most-frequent label: forest + ROC/PR areas +
importances) and ``clustering_report`` (scale on train, K-Means on
train + test, PCA, centres, chart tables).

The cleaned table (train and test together, told apart by a 'split'
column, cut to the columns later steps read) is persisted once
(MEMORY_AND_DISK) because the encoder fit, every model fit and every
evaluation read it again; ``Prepared.release()`` frees it.  Lost cached
blocks are recomputed from the parquet lineage, which is short (scan -> one
projection -> hash split).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark import StorageLevel
from pyspark.ml.feature import StringIndexerModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.functions.columns import string_columns
from riskspark.operators import chartdata, cluster, dictionary, evaluate, features, models
from riskspark.operators.clean import CleaningModel, fit_cleaning
from riskspark.operators.profile import group_counts
from riskspark.operators.split import hash_split, random_split, spread, union_parts, with_split
from riskspark.roles import Roles


@dataclass
class Prepared:
    roles: Roles
    cleaning: CleaningModel | None
    data: DataFrame              # whole assembled table with a 'split' column
    train: DataFrame
    test: DataFrame
    feature_names: list[str]
    label_index: str
    encoders: StringIndexerModel
    encoded: list[str] = field(default_factory=list)
    cached: DataFrame | None = None   # the persisted cleaned, split-marked columns

    def release(self) -> None:
        if self.cached is not None:
            self.cached.unpersist()


def prepare(df: DataFrame, roles: Roles, fraction: float = 0.8, split_key: str | list[str] | None = None,
            clean: bool = True, handle_invalid: str = "error",
            feature_types: list[str] | None = None, duplicate_indexed: bool = False,
            exclude: tuple[str, ...] = (), quantile_method: str = "exact", persist: bool = True,
            partitions: int | None = None, random_seed: int | None = None, fit_on_train: bool = False,
            wide: tuple[str, ...] = (), **cleaning_options) -> Prepared:
    """Clean, split, encode and assemble.

    ``partitions``: deal the cleaned rows into so many (bagging follows
    partitions, so the number is the caller's); ``random_seed``: the
    reference's ``randomSplit`` instead of the hash split; ``fit_on_train``: cleaning
    statistics from the training part alone (hash split only); ``cleaning_options``: those of ``fit_cleaning``
    (``bad_time``, ``impute_id``, ``clip_label``, ``date_format``, ``time_format``).
    ``feature_types`` filters by the types that columns have in the reference.
    ``wide``: text columns of many values, encoded by a distributed dictionary (``operators.dictionary``) instead of a
    list on the driver; their indices are plain numbers to a tree, without a limit by its bins.

    The cleaned table, marked with a 'split' column and cut to the columns
    the later steps read, is persisted once: the encoder fit, the
    forest and the evaluations all read it.  The assembled table is a
    projection over it (string indexing and the assembler), with train and
    test as filters on the 'split' column."""
    key = split_key if split_key is not None else roles.id
    if fit_on_train and random_seed is not None:
        raise ValueError("fit_on_train needs the hash split")
    source = hash_split(df, key, fraction)[0] if fit_on_train else df
    cleaning = fit_cleaning(source, roles, quantile_method=quantile_method, **cleaning_options) if clean else None
    cleaned = cleaning.transform(df) if cleaning else df
    skip = set(roles.named()) | set(roles.passthrough) | set(exclude)
    encoded = string_columns(cleaned, exclude=skip)
    label_index = features.indexed_name(roles.label)
    indexed = [features.indexed_name(c) for c in encoded]

    if random_seed is None:
        marked = with_split(cleaned, key, fraction)
    else:
        train, test = random_split(cleaned, fraction, random_seed)
        marked = union_parts(train.withColumn("split", F.lit("train")), test.withColumn("split", F.lit("test")))
    # The feature list depends on the schema only: the encoded columns are
    # doubles, so a schema with them stand-in as double literals decides it
    # before anything runs.
    shape = marked.select("*", *[F.lit(0.0).alias(c) for c in indexed])
    names = features.feature_columns(shape, indexed, exclude=skip | {label_index, "split"},
                                     feature_types=feature_types, duplicate_indexed=duplicate_indexed,
                                     types=cleaning.reference_types() if cleaning else None)
    keep = list(dict.fromkeys([c for c in (roles.id, roles.label) if c] + encoded
                              + [c for c in names if c not in set(indexed)] + ["split"]))
    cached = None
    if persist:
        cached = marked.select(*keep)
        if partitions is not None:
            cached = cached.repartition(partitions)
        cached = cached.persist(StorageLevel.MEMORY_AND_DISK)
        marked = cached
    is_train = F.col("split") == "train"
    encoders = features.fit_encoders(marked.where(is_train), [c for c in encoded if c not in wide], roles.label, handle_invalid)
    coded = encoders.transform(marked)
    many = {c: features.indexed_name(c) for c in encoded if c in wide}
    if many:
        coded = dictionary.encode(coded, dictionary.fit_dictionary(marked.where(is_train), list(many)), many, handle_invalid)
    data = features.assemble(coded, names).select(
        *[c for c in dict.fromkeys([roles.id, roles.label, label_index]) if c], "features", "split")
    return Prepared(roles, cleaning, data, data.where(is_train), data.where(~is_train), names,
                    label_index, encoders, encoded, cached)


def multiclass_report(prep: Prepared, params: models.ForestParams = models.ForestParams(),
                      top: int = 10) -> dict[str, DataFrame]:
    spark = prep.train.sparkSession
    model = models.fit_forest(prep.train, prep.label_index, params=params)
    scored = model.transform(prep.test)
    metrics = evaluate.accuracy_f1(scored, prep.label_index)
    imp = models.importance_frame(spark, model, prep.feature_names)
    return {"metrics": metrics, "importance": imp, "top_features": chartdata.top_features(imp, top),
            "model": model}


def binary_report(prep: Prepared, params: models.ForestParams = models.ForestParams(),
                  num_bins: int = 0, positive: list[float] | None = None, top: int = 10) -> dict:
    """Entry B.  ``num_bins=0`` (default): exact ROC/PR areas from one
    pipeline; ``num_bins=1000`` is the reference's binned MLlib evaluator,
    whose bins follow the sort's partitions."""
    spark = prep.train.sparkSession
    train = prep.train.withColumn("is_severe", features.binary_label(prep.label_index, positive))
    test = prep.test.withColumn("is_severe", features.binary_label(prep.label_index, positive))
    counts = group_counts(train, "is_severe")
    model = models.fit_forest(train, "is_severe", params=params)
    scored = model.transform(test)
    areas = evaluate.binary_areas(scored, "is_severe", "rawPrediction", num_bins=num_bins)
    metrics = spark.createDataFrame([(areas["area_roc"], areas["area_pr"])], "area_roc double, area_pr double")
    imp = models.importance_frame(spark, model, prep.feature_names)
    return {"label_counts": counts, "metrics": metrics, "importance": imp,
            "top_features": chartdata.top_features(imp, top), "model": model}


class Clustering:
    """Scale (fit on train), K-Means and PCA on train + test, centres and chart
    tables.  Each step runs when it is first asked for, so a caller that wants
    sizes fits no PCA.  ``keep`` columns (the row id) travel with each point.

    ``partitions``: deal the scaled vectors into so many before the fits."""

    def __init__(self, marked: DataFrame, keep: list[str], features_col: str = "features", k: int = 3, seed: int = 42,
                 pca_k: int = 2, bins: int = 100, partitions: int | None = None):
        self.spark, self.keep, self.k, self.seed, self.pca_k, self.bins = marked.sparkSession, keep, k, seed, pca_k, bins
        scaler = features.fit_scaler(marked.where(F.col("split") == "train"), features_col)
        self.scaled = scaler.transform(marked).select(*keep, "scaledFeatures")
        spread_out = self.scaled if partitions is None else spread(self.scaled, partitions)
        # K-Means reads the scaled vectors again and again, PCA twice.
        self.data = spread_out.persist(StorageLevel.MEMORY_AND_DISK)

    def release(self) -> None:
        self.data.unpersist()

    @cached_property
    def kmeans(self):
        return cluster.fit_kmeans(self.data, "scaledFeatures", k=self.k, seed=self.seed)

    @cached_property
    def pca(self):
        return cluster.fit_pca(self.data, "scaledFeatures", k=self.pca_k)

    @property
    def assigned(self) -> DataFrame:
        return self.kmeans.transform(self.data)

    def sizes(self) -> DataFrame:
        return chartdata.cluster_sizes(self.assigned)

    def centers(self, digits: int = 2) -> DataFrame:
        return cluster.centers_rounded(self.spark, self.kmeans, digits)

    def explained(self) -> DataFrame:
        return cluster.explained_frame(self.spark, self.pca)

    def points(self) -> DataFrame:
        return cluster.project_xy(self.assigned, self.pca, self.keep + [F.col("prediction").alias("cluster")])

    def centers_xy(self) -> DataFrame:
        return cluster.project_xy(cluster.centers_frame(self.spark, self.kmeans), self.pca, ["cluster"])

    def scatter(self) -> DataFrame:
        return chartdata.cluster_scatter(self.points(), self.centers_xy(), self.bins)
