"""K-Means and PCA, checked by properties on a small fixture."""

import numpy as np

from riskspark.functions.vectors import to_vector
from riskspark.operators import cluster


def _points(spark, n=300, d=4, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 5, (3, d))
    pts = np.vstack([centres[i % 3] + rng.normal(0, 1, d) for i in range(n)])
    df = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(pts)], "id long, x array<double>")
    return df, pts


def test_kmeans_pca_properties(spark):
    df, _ = _points(spark, n=240, d=4)
    vec = df.select("id", to_vector("x").alias("scaledFeatures"))
    km = cluster.fit_kmeans(vec, k=3, seed=42)
    assigned = km.transform(vec)
    sizes = {r["prediction"]: r["count"] for r in assigned.groupBy("prediction").count().collect()}
    assert sum(sizes.values()) == 240 and len(sizes) == 3
    # every point's assigned centre is its nearest one
    cents = cluster.centers(km)
    arr = np.array([r["x"] for r in df.orderBy("id").collect()])
    pred = [r["prediction"] for r in assigned.orderBy("id").collect()]
    d = ((arr[:, None, :] - np.array(cents)[None, :, :]) ** 2).sum(-1)
    assert pred == list(d.argmin(1))
    pca = cluster.fit_pca(vec, k=2)
    ev = pca.explainedVariance.toArray()
    assert ev[0] >= ev[1] and ev.sum() <= 1.0 + 1e-12
    signs = cluster.pca_signs(pca)
    pc = pca.pc.toArray()
    for j, s in enumerate(signs):
        col = np.round(pc[:, j] * s, 9)
        assert col[np.argmax(np.abs(col))] > 0
    xy = cluster.project_xy(vec, pca, ["id"])
    assert xy.count() == 240 and set(xy.columns) == {"id", "pca_x", "pca_y"}


def test_many_categories_go_into_clustering(spark):
    """Trees bound the number of categories, clusterings don't."""
    import pytest

    from riskspark.operators import models
    from riskspark.plans import analyses
    from riskspark.roles import Roles
    rows = [(i, "ab"[i % 2], f"c{i % 40}", float(i % 7)) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, lab string, cat string, x double")
    prep = analyses.prepare(df, Roles(id="id", label="lab"))
    try:
        c = analyses.Clustering(prep.data, ["id"], partitions=3)
        assert sum(r["n"] for r in c.sizes().collect()) == 400
        assert "pca" not in vars(c)                      # sizes fit no PCA
        c.release()
        with pytest.raises(models.ArityError):
            analyses.multiclass_report(prep)
        wide = analyses.multiclass_report(prep, models.ForestParams(num_trees=2, max_bins=64))
        assert wide["metrics"].count() == 1
    finally:
        prep.release()
