"""Evaluation aggregates (V1-V4).

Accuracy and support-weighted F1 come from one confusion-count aggregate
(bounded by classes^2), then per-class sums without a join.

ROC and PR areas: with ``num_bins > 0`` MLlib's evaluator (the reference's,
which down-samples the curve to about that many points; one sort of the
scores per metric).  With ``num_bins=0`` the exact curve comes from one
DataFrame pipeline that yields both areas: positives and negatives per
distinct score (a map-side combined group-by, so a hot score is one row),
the distinct scores cut into a fixed number of ranges at approximate quantiles, the
running counts inside each range (a window partitioned by range) plus the
counts of all higher ranges (a broadcast of one row per range), and one sum
of the trapezoids.  No task sorts more than one range.
"""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def confusion(pred: DataFrame, label: str, prediction: str = "prediction") -> DataFrame:
    """(label, prediction, n) counts."""
    return (pred.groupBy(F.col(label).cast("double").alias("label"),
                         F.col(prediction).cast("double").alias("prediction"))
            .agg(F.count(F.lit(1)).alias("n")))


def accuracy_f1(pred: DataFrame, label: str, prediction: str = "prediction") -> DataFrame:
    """V1 + V2 in one pass: one row (accuracy, f1); f1 is weighted by class support.

    Per class k: f1_k = 2 tp / (predicted + actual), 0 when tp = 0."""
    conf = confusion(pred, label, prediction)
    same = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(F.lit(0))
    sides = F.array(
        F.struct(F.col("label").alias("k"), F.col("n").alias("ap"), same.alias("tp"), F.lit(0).cast("bigint").alias("pp")),
        F.struct(F.col("prediction").alias("k"), F.lit(0).cast("bigint").alias("ap"), F.lit(0).cast("bigint").alias("tp"),
                 F.col("n").alias("pp")),
    )
    per = (conf.select(F.inline(sides)).groupBy("k")
           .agg(F.sum("ap").alias("ap"), F.sum("tp").alias("tp"), F.sum("pp").alias("pp")))
    f1k = F.when(F.col("tp") > 0, 2.0 * F.col("tp") / (F.col("pp") + F.col("ap"))).otherwise(F.lit(0.0))
    return per.agg(
        (F.sum("tp") / F.sum("ap")).alias("accuracy"),
        (F.sum(f1k * F.col("ap")) / F.sum("ap")).alias("f1"),
    )


def _score_column(df: DataFrame, score: str):
    c = F.col(score)
    if isinstance(df.schema[score].dataType, VectorUDT):
        c = vector_to_array(c)[1]
    return c.cast("double")


def binary_areas(pred: DataFrame, label: str, score: str = "rawPrediction",
                 num_bins: int = 1000) -> dict[str, float]:
    """V3 + V4: areas under the ROC and the precision-recall curves.

    ``score`` is a double or a vector (its element 1 is the score).
    ``num_bins=0`` is the exact curve (``exact_areas``); otherwise MLlib's
    evaluator with that many bins."""
    if num_bins == 0:
        return exact_areas(pred, label, score)
    data = pred.select(F.col(label).cast("double").alias("label"), F.col(score).alias("score"))
    # Two evaluations read the same two columns: keep them (not the whole
    # scoring lineage) between the passes.
    data = data.persist(StorageLevel.MEMORY_AND_DISK)
    out = {}
    try:
        for metric, key in (("areaUnderROC", "area_roc"), ("areaUnderPR", "area_pr")):
            ev = BinaryClassificationEvaluator(labelCol="label", rawPredictionCol="score",
                                               metricName=metric, numBins=num_bins)
            out[key] = ev.evaluate(data)
    finally:
        data.unpersist()
    return out


#: Score ranges of the exact curve; fixed, so results and plans don't depend on the number of scores.
SCORE_RANGES = 64


def exact_areas(pred: DataFrame, label: str, score: str = "rawPrediction", ranges: int = SCORE_RANGES) -> dict[str, float]:
    """Exact areas under the ROC and PR curves, both from one pipeline.

    A label above 0.5 is positive (as in MLlib).  Rows with a NULL label or a NULL
    or NaN score are left out; infinite scores are scores like others.  Without
    positives both areas are 0, without negatives both are 1 (as in MLlib); NaN if
    no row is left.  Thresholds are the distinct scores, highest first; the ROC curve starts at (0, 0), the PR
    curve at recall 0 with the first point's precision.  With tp, fp the
    counts at or above a score and pos, neg the counts at it, the trapezoid
    areas are

        ROC = sum(neg * (tp - pos / 2)) / (P * N)
        PR  = sum(pos * (precision + previous precision) / 2) / P

    where the previous point's counts are (tp - pos, fp - neg), so no row
    needs its neighbour.  Running counts are taken inside ``ranges`` score ranges."""
    s, y = _score_column(pred, score), F.col(label).cast("double")
    per = (pred.where(y.isNotNull() & s.isNotNull() & ~F.isnan(s))
           .select(s.alias("score"), (y > 0.5).cast("long").alias("p"))
           .groupBy("score")
           .agg(F.sum("p").alias("pos"), (F.count(F.lit(1)) - F.sum("p")).alias("neg")))
    per = per.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        probs = [i / ranges for i in range(1, ranges)] or [0.5]
        head = per.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"),
                       F.percentile_approx("score", probs, 100 * ranges).alias("q")).first()
        P, N = int(head["P"] or 0), int(head["N"] or 0)
        if P == 0 or N == 0:
            only = math.nan if P + N == 0 else float(P > 0)
            return {"area_roc": only, "area_pr": only}
        cuts = sorted(set(float(v) for v in head["q"]))[:ranges - 1]
        place = F.lit(0)
        for c in cuts:
            place = place + (F.col("score") > F.lit(c)).cast("int")
        ranged = per.withColumn("r", place)
        # Counts in all higher ranges: one row for each of the fixed number of ranges.
        totals = ranged.groupBy("r").agg(F.sum("pos").alias("rp"), F.sum("neg").alias("rn"))
        higher = Window.orderBy(F.desc("r")).rowsBetween(Window.unboundedPreceding, -1)
        offsets = totals.select("r", F.coalesce(F.sum("rp").over(higher), F.lit(0)).alias("op"),
                                F.coalesce(F.sum("rn").over(higher), F.lit(0)).alias("on"))
        inside = Window.partitionBy("r").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding,
                                                                              Window.currentRow)
        cum = (ranged.join(F.broadcast(offsets), "r")
               .select("pos", "neg",
                       (F.col("op") + F.sum("pos").over(inside)).cast("double").alias("tp"),
                       (F.col("on") + F.sum("neg").over(inside)).cast("double").alias("fp")))
        tpp, fpp = F.col("tp") - F.col("pos"), F.col("fp") - F.col("neg")
        prec = F.col("tp") / (F.col("tp") + F.col("fp"))
        prev = F.when(tpp + fpp > 0, tpp / (tpp + fpp)).otherwise(prec)
        row = cum.agg(F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2.0)).alias("roc"),
                      F.sum(F.col("pos") * (prec + prev) / 2.0).alias("pr")).first()
        return {"area_roc": float(row["roc"]) / (float(P) * float(N)), "area_pr": float(row["pr"]) / float(P)}
    finally:
        per.unpersist()
