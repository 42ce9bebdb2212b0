"""Feature engineering (E1-E6): string encoding, feature list, vector
assembly, binary label, standard scaling.  Built on ``pyspark.ml``.

Encoders and the scaler are fitted on the training part only and applied
to both parts (the reference's split-before-encoding rule).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.ml.feature import StandardScaler, StandardScalerModel, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.functions.columns import numeric_columns

def indexed_name(col: str) -> str:
    return f"{col}_indexed"


def fit_indexers(train: DataFrame, cols: list[str], handle_invalid: str = "error") -> StringIndexerModel | None:
    """One multi-column StringIndexer (one fit job for all columns).

    Order: most frequent first, ties alphabetical.  ``handle_invalid`` is
    'error' (unseen or missing values fail when an action runs), 'keep'
    (they get index = number of labels) or 'skip' (the row is dropped).  The
    number of values is bounded by the use of the index alone: a tree checks it
    against its bins (``models.fit_forest``), clustering takes any."""
    if not cols:
        return None
    return StringIndexer(inputCols=cols, outputCols=[indexed_name(c) for c in cols],
                         handleInvalid=handle_invalid, stringOrderType="frequencyDesc").fit(train)


def fit_encoders(train: DataFrame, cols: list[str], label: str | None = None,
                 handle_invalid: str = "error") -> StringIndexerModel:
    """E1 + E2 in one fit job: the categorical feature columns and the label share one StringIndexer."""
    return fit_indexers(train, list(cols) + ([label] if label else []), handle_invalid)


def fit_label_indexer(train: DataFrame, label: str, out: str | None = None,
                      handle_invalid: str = "error") -> StringIndexerModel:
    """Label encoding; numeric labels are encoded by their text form."""
    return StringIndexer(inputCol=label, outputCol=out or indexed_name(label),
                         handleInvalid=handle_invalid, stringOrderType="frequencyDesc").fit(train)


def index_map_frame(spark: SparkSession, model: StringIndexerModel, cols: list[str]) -> DataFrame:
    """The fitted value -> index map as a table (bounded by the checked arity)."""
    rows = [(c, v, float(i)) for c, labels in zip(cols, model.labelsArray) for i, v in enumerate(labels)]
    return spark.createDataFrame(rows, "column_name string, value string, idx double")


def feature_columns(df: DataFrame, indexed: list[str], exclude: Iterable[str] = (),
                    feature_types: Iterable[str] | None = None,
                    duplicate_indexed: bool = False, types: dict[str, str] | None = None) -> list[str]:
    """Encoded columns first, then the numeric columns, each once.

    ``feature_types={'int', 'double'}`` keeps only those types (the
    reference's filter, which leaves out bigint columns); ``types`` gives the type of a
    column in the reference where it differs from the schema's.  With
    ``duplicate_indexed=True`` the encoded columns are listed a second time
    among the numeric ones, as the reference's list does."""
    skip = set(exclude)
    numeric = numeric_columns(df, exclude=skip)
    if feature_types is not None:
        schema = {f.name: f.dataType.simpleString() for f in df.schema.fields} | (types or {})
        numeric = [c for c in numeric if schema[c] in set(feature_types)]
    if duplicate_indexed:
        return list(indexed) + numeric
    return list(indexed) + [c for c in numeric if c not in set(indexed)]


def assemble(df: DataFrame, cols: list[str], out: str = "features", handle_invalid: str = "error") -> DataFrame:
    """One vector per row; NULL or NaN fails the job unless 'skip'/'keep'."""
    return VectorAssembler(inputCols=cols, outputCol=out, handleInvalid=handle_invalid).transform(df)


def binary_label(index_col: str | Column, positive: Iterable[float] | None = None) -> Column:
    """E5: 1 when the label index is not 0 (not the most frequent training
    label), or when it is in ``positive``; as int."""
    c = F.col(index_col) if isinstance(index_col, str) else index_col
    cond = c.isin([float(v) for v in positive]) if positive is not None else (c > 0)
    return F.when(cond, 1).otherwise(0).cast("integer")


def fit_scaler(train: DataFrame, col: str = "features", out: str = "scaledFeatures",
               with_mean: bool = False) -> StandardScalerModel:
    """Divide by the sample standard deviation (n - 1); zero-variance
    features become 0; no centring unless ``with_mean``."""
    return StandardScaler(inputCol=col, outputCol=out, withStd=True, withMean=with_mean).fit(train)
