"""Operators 3 and 7: held-out accuracy, folds, odd rows."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from riskspark.llm import quality, toxicity
from riskspark.llm.common import table
from riskspark.llm.learning import fold, word_grams
from tests.conftest import SF001
from tests.llm.helpers import clashing, empty, odd


def confusion(scores, labels, col):
    rows = scores.join(labels, "doc_id").where("held_out").groupBy(col, "predicted").count().collect()
    return {(r[col], r["predicted"]): r["count"] for r in rows}


def test_fold(spark):
    df = spark.createDataFrame([(i,) for i in [0, 1, 17, 123456, -4]], "doc_id long")
    assert {r.doc_id: r.f for r in df.withColumn("f", fold("doc_id", 5)).collect()} == \
        {i: zlib.crc32(str(i).encode()) % 5 for i in [0, 1, 17, 123456, -4]}


def test_word_grams_depend_on_the_word_alone():
    words = ["alpha", "be", "ünïcode", "x", "日本語", "alpha2"]
    feats, owner = word_grams(words, 1 << 16, grams=(2, 3), prefixes=(4,))
    for i, w in enumerate(words):
        alone, _ = word_grams([w], 1 << 16, grams=(2, 3), prefixes=(4,))
        assert sorted(alone.tolist()) == sorted(feats[owner == i].tolist())
        assert len(alone) == 1 + (len(w) + 1) + len(w) + (len(w) > 4)


def test_word_pairs_and_shapes():
    p = quality.QualityParams()
    codes = quality.word_codes("a b a b c c".split())
    pairs = quality.word_pairs(codes, p)
    assert pairs[0] == pairs[2] and len(set(pairs.tolist())) == 4
    assert all(p.buckets <= x < p.buckets + p.pair_buckets for x in pairs)
    assert (quality.word_shapes(codes, p) - p.buckets - p.pair_buckets).tolist() == [0, 0, 2, 2, 0, 1]
    assert len(quality.word_pairs(codes[:1], p)) == len(quality.word_pairs(codes[:0], p)) == len(quality.word_shapes(codes[:0], p)) == 0


def test_quality_scores_equal_the_features_dot_the_values():
    p = quality.QualityParams(buckets=64, pair_buckets=64)
    values = np.random.default_rng(3).normal(size=p.size).astype(np.float32)
    texts = ["", "one", "one one", "a b a b a b", "many words that part and words that part", "x " * 50]
    scores = quality.QualityModel(p, values, 0.3).scorer()(texts)
    for text, score in zip(texts, scores):
        ids, counts = quality.text_features(text, p)
        mean = (values[ids].astype(float) @ counts) / counts.sum() if len(ids) else 0.0
        assert abs(score - 1 / (1 + np.exp(-0.3 - mean))) < 1e-9


def test_quality_held_out(spark):
    labels = table(spark, SF001, "labels")
    scores = quality.quality_scores(table(spark, SF001, "documents"), labels).cache()
    got = confusion(scores, labels, "quality")
    right = got.get((0, 0), 0) + got.get((1, 1), 0)
    assert right >= 0.95 * sum(got.values())
    assert scores.where("score < 0 or score > 1 or score is null").count() == 0
    assert scores.count() == 1000


def test_toxicity_held_out(spark):
    labels = table(spark, SF001, "labels")
    got = confusion(toxicity.toxicity_scores(table(spark, SF001, "documents"), labels), labels, "toxic")
    assert got.get((1, 1), 0) >= 0.8 * (got.get((1, 1), 0) + got.get((1, 0), 0))
    assert got.get((0, 1), 0) <= 0.03 * got[(0, 0)]


def test_held_out_labels_are_not_read(spark):
    docs, labels = table(spark, SF001, "documents"), table(spark, SF001, "labels")
    for module, col, parts, held in ((quality, "quality", 5, 0), (toxicity, "toxic", 4, 2)):
        turned = labels.withColumn(col, F.when(fold("doc_id", parts) == held, 1 - F.col(col)).otherwise(F.col(col)))
        scores = quality.quality_scores if module is quality else toxicity.toxicity_scores
        a, b = (sorted((r.doc_id, r.score) for r in scores(docs, x).collect()) for x in (labels, turned))
        assert a == b


def test_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 0, 1), (5, 0, 1), (None, 1, 0), (6, None, None), (7, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    none = labels.limit(0)
    for scores in (quality.quality_scores, toxicity.toxicity_scores):
        for known in (labels, none):
            rows = scores(odd(spark), known).collect()
            assert len(rows) == 10 and all(0 <= r.score <= 1 for r in rows)
            assert len({r.score for r in rows if r.doc_id in (2, 3)}) == 1
            assert not any(r.held_out for r in rows if r.doc_id is None)
        assert scores(empty(spark), labels).count() == 0
        assert scores(clashing(odd(spark), "score", "ids", "quality"), clashing(labels, "text", "score")).count() == 10


def test_risk_is_kept_from_below():
    """Positives hidden among the unlabelled are found, other texts are left alone."""
    from riskspark.llm.learning import Rows
    rng = np.random.default_rng(0)
    p = toxicity.ToxicityParams(buckets=64, least_texts=1, sparsity=1e-4)
    make = lambda toxic: np.unique(np.concatenate((rng.integers(4, 64, 12), [rng.integers(0, 4)] if toxic else [])).astype(np.int32))
    pos, hidden, clean = ([make(t) for _ in range(n)] for t, n in ((True, 300), (True, 100), (False, 900)))
    rows = lambda xs: Rows(list(xs), [np.ones(len(x), np.float32) for x in xs])
    model = toxicity.train(rows(pos), rows(hidden + clean), 0.1, p)
    z = lambda xs: np.array([model.bias + model.weight[x].sum() for x in xs])
    assert (z(hidden) > -0.8).mean() > 0.95 and (z(clean) > -0.8).mean() < 0.05
