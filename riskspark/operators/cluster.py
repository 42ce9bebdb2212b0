"""Clustering and projection.

K-Means (k-means|| start) and PCA are MLlib's: K-Means broadcasts the k
centres each round; PCA sums a d x d Gramian with a tree aggregate and solves
the eigenproblem on the driver, so MLlib bounds d."""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import PCA, PCAModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.functions.exprs import round_half_up
from riskspark.sources.readers import literal_vectors


def fit_kmeans(df: DataFrame, features: str = "scaledFeatures", k: int = 3, seed: int = 42,
               max_iter: int = 20, tol: float = 1e-4, init_mode: str = "k-means||",
               init_steps: int = 2, prediction: str = "prediction") -> KMeansModel:
    """M6 with the reference's settings (k=3, seed 42, MLlib defaults otherwise)."""
    km = KMeans(k=k, featuresCol=features, predictionCol=prediction, seed=seed, maxIter=max_iter,
                tol=tol, initMode=init_mode, initSteps=init_steps)
    return km.fit(df)


def centers(model: KMeansModel) -> list[list[float]]:
    return [list(map(float, c)) for c in model.clusterCenters()]


def centers_frame(spark: SparkSession, model: KMeansModel, col: str = "scaledFeatures") -> DataFrame:
    """The k centres as a small vector table (cluster, col)."""
    return literal_vectors(spark, centers(model), col=col, id_col="cluster")


def centers_rounded(spark: SparkSession, model: KMeansModel, digits: int = 2) -> DataFrame:
    """M8: centres with each coordinate rounded (cluster, dim, value)."""
    rows = [(i, j, float(v)) for i, c in enumerate(centers(model)) for j, v in enumerate(c)]
    df = spark.createDataFrame(rows, "cluster int, dim int, value double")
    return df.withColumn("value", round_half_up(F.col("value"), digits))


def fit_pca(df: DataFrame, col: str = "scaledFeatures", k: int = 2, out: str = "pcaFeatures") -> PCAModel:
    """Principal components of the centred covariance (transform does not centre)."""
    return PCA(k=k, inputCol=col, outputCol=out).fit(df)


def pca_signs(model: PCAModel, digits: int = 9) -> list[float]:
    """Flip each component so its largest absolute loading (rounded,
    first index on ties) is positive; PCA's own sign is arbitrary."""
    pc = model.pc.toArray()
    signs = []
    for j in range(pc.shape[1]):
        col = np.round(pc[:, j], digits)
        i = int(np.argmax(np.abs(col)))
        signs.append(-1.0 if col[i] < 0 else 1.0)
    return signs


def explained_frame(spark: SparkSession, model: PCAModel) -> DataFrame:
    """(component, explained, explained_pct); shares of total variance."""
    ev = [float(v) for v in model.explainedVariance.toArray()]
    rows = [(i + 1, v, 100.0 * v) for i, v in enumerate(ev)]
    return spark.createDataFrame(rows, "component int, explained double, explained_pct double")


def project_xy(df: DataFrame, model: PCAModel, keep: list[str], out_x: str = "pca_x",
               out_y: str = "pca_y") -> DataFrame:
    """The first two components as columns, signs fixed."""
    sx, sy = pca_signs(model)[:2]
    arr = vector_to_array(F.col(model.getOutputCol()))
    return model.transform(df).select(*keep, (arr[0] * F.lit(sx)).alias(out_x),
                                      (arr[1] * F.lit(sy)).alias(out_y))
