"""Operator 3: a quality classifier on supervised subword embeddings.

Each word stands for hashed features: itself and its character n-grams; each pair
of neighbouring words is a hashed feature, and each word's shape: which of the
words shortly before it are the same word.  Shapes let repeats of words that were
never learned count.  A document is the mean of its features' learned vectors; a
softmax layer over the mean gives the classes.
Vectors and layer are trained together by stochastic gradient descent in numpy
on a bounded sample of labelled rows.  As the layer is linear, a trained model
scores a document from one number per word and word pair, so scoring is one narrow pass."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm.learning import Rows, WordMemory, add_scores, first_by_hash, fold, sigmoid, sparse_features, word_grams
from riskspark.llm.textkernel import mix

# Fixed values of the contract: folds of labelled rows, the fold that is held out, the threshold.
FOLDS = 5
HELD_OUT = 0
THRESHOLD = 0.3


@dataclass(frozen=True)
class QualityParams:
    """``sample_per_class`` bounds the labelled rows that are learned from (all of
    them, if fewer); ``pair_weight`` and ``shape_weight`` are how many features a
    word pair and a shape count as; shapes look ``reach`` words back."""

    sample_per_class: int = 2000
    buckets: int = 1 << 17
    dim: int = 8
    grams: tuple[int, ...] = (2, 3)
    pair_buckets: int = 1 << 17
    pair_weight: int = 1
    shape_weight: int = 4
    reach: int = 3
    epochs: int = 12
    batch: int = 16
    rate: float = 0.25
    seed: int = 7

    @property
    def size(self) -> int:
        """All buckets: words and n-grams, pairs, shapes."""
        return self.buckets + self.pair_buckets + (1 << self.reach)


def word_codes(words: list[str]) -> np.ndarray:
    """One number below 2**31 per word, from its characters."""
    return word_grams(words, (1 << 31) - 1)[0]


def word_pairs(codes: np.ndarray, p: QualityParams) -> np.ndarray:
    """The bucket of each pair of neighbours, past the buckets of words and n-grams."""
    left, right = codes[:-1].astype(np.uint64), codes[1:].astype(np.uint64)
    return p.buckets + (mix((left << np.uint64(31)) + right) % np.uint64(p.pair_buckets)).astype(np.int64)


def word_shapes(codes: np.ndarray, p: QualityParams) -> np.ndarray:
    """The bucket of each word's shape, past all others: one bit for each of the words before it that it equals."""
    bits = np.zeros(len(codes), np.int64)
    for back in range(1, min(p.reach, len(codes) - 1) + 1):
        bits[back:] |= (codes[back:] == codes[:-back]).astype(np.int64) << (back - 1)
    return p.buckets + p.pair_buckets + bits


def text_features(text: str, p: QualityParams) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of words, n-grams, word pairs and shapes."""
    words = text.split()
    counted = Counter(words)
    place = dict(zip(counted, range(len(counted))))
    feats, owner = word_grams(list(counted), p.buckets, p.grams)
    times = np.fromiter(counted.values(), np.float64, len(counted))
    codes = word_codes(list(counted))[np.fromiter(map(place.__getitem__, words), np.int64, len(words))]
    pairs, shapes = word_pairs(codes, p), word_shapes(codes, p)
    ids, where = np.unique(np.concatenate((feats, pairs, shapes)), return_inverse=True)
    weights = np.concatenate((times[owner], np.full(len(pairs), float(p.pair_weight)), np.full(len(shapes), float(p.shape_weight))))
    return ids, np.bincount(where, weights, len(ids)) if len(ids) else np.zeros(0)


@dataclass
class QualityModel:
    """``value``: each bucket's contribution to the log-odds of class 1 before averaging."""

    params: QualityParams
    value: np.ndarray
    bias: float

    def scorer(self):
        p, value, bias = self.params, self.value.astype(np.float64), self.bias

        def figures(words: list[str]) -> np.ndarray:
            feats, owner = word_grams(words, p.buckets, p.grams)
            return np.stack((np.bincount(owner, value[feats], len(words)), np.bincount(owner, minlength=len(words)),
                             word_codes(words)), 1)

        memory = WordMemory(figures)

        def score(texts: list[str]) -> list[float]:
            words = [t.split() for t in texts]
            out = []
            for rows in memory.look_up(words):
                pairs, shapes = word_pairs(rows[:, 2], p), word_shapes(rows[:, 2], p)
                total = rows[:, 0].sum() + p.pair_weight * value[pairs].sum() + p.shape_weight * value[shapes].sum()
                count = rows[:, 1].sum() + p.pair_weight * len(pairs) + p.shape_weight * len(shapes)
                out.append(float(sigmoid(bias + (total / count if count else 0.0))))
            return out

        return score


def train(rows: Rows, labels: np.ndarray, p: QualityParams, prior: float | None = None) -> QualityModel:
    """Softmax regression over mean feature vectors.  Classes weigh alike while
    training; ``prior`` (share of class 1) then moves the log-odds back.

    With one class only, or no rows, the vectors stay unused and the bias alone answers."""
    n_pos, n = int(labels.sum()), len(labels)
    shift = float(np.log((prior or 0.5) / (1 - (prior or 0.5)))) if prior is None or 0 < prior < 1 else 0.0
    if n_pos == 0 or n_pos == n:
        only = 0.0 if n == 0 else (4.0 if n_pos else -4.0)
        return QualityModel(p, np.zeros(p.size, np.float32), only)
    rng = np.random.default_rng(p.seed)
    vec = rng.uniform(-1.0 / p.dim, 1.0 / p.dim, (p.size, p.dim)).astype(np.float32)
    out, bias = np.zeros((2, p.dim), np.float32), np.zeros(2, np.float32)
    weight = np.where(labels == 1, n / (2.0 * n_pos), n / (2.0 * (n - n_pos))).astype(np.float32)
    total = np.maximum(np.add.reduceat(np.append(rows.counts, 0), rows.start[:-1]) * (np.diff(rows.start) > 0), 1.0)
    steps = p.epochs * -(-n // p.batch)
    step = 0
    for _ in range(p.epochs):
        order = rng.permutation(n)
        for lo in range(0, n, p.batch):
            pick = order[lo:lo + p.batch]
            rate = p.rate * (1 - step / steps)
            step += 1
            ids, counts, which = rows.take(pick)
            share = (counts / total[pick][which]).astype(np.float32)
            mean = np.zeros((len(pick), p.dim), np.float32)
            for d in range(p.dim):
                mean[:, d] = np.bincount(which, share * vec[ids, d], len(pick))
            z = mean @ out.T + bias
            z -= z.max(axis=1, keepdims=True)
            prob = np.exp(z)
            prob /= prob.sum(axis=1, keepdims=True)
            prob[np.arange(len(pick)), labels[pick]] -= 1.0
            grad = prob * weight[pick][:, None]
            back = grad @ out
            out -= rate * grad.T @ mean
            bias -= rate * grad.sum(axis=0)
            np.subtract.at(vec, ids, rate * share[:, None] * back[which])
    return QualityModel(p, vec @ (out[1] - out[0]), float(bias[1] - bias[0]) + shift)


def fit(docs: DataFrame, labels: DataFrame, params: QualityParams = QualityParams()) -> QualityModel:
    """Learn from labelled rows outside the held-out fold.

    Rows with a NULL id or label are left out; of repeated labels of an id, the
    largest counts."""
    known = labels.where(fold("doc_id", FOLDS) != HELD_OUT).where("quality in (0, 1)") \
                  .groupBy("doc_id").agg(F.max("quality").alias("quality"))
    share = known.agg(F.avg("quality")).first()[0]
    ids = [first_by_hash(known.where(F.col("quality") == q).select("doc_id"), params.sample_per_class)
           .withColumn("quality", F.lit(q)) for q in (0, 1)]
    chosen = ids[0].union(ids[1]).collect()                     # at most two classes' bounded samples
    label = {r["doc_id"]: r["quality"] for r in chosen}
    spark = docs.sparkSession
    if not label:
        return train(Rows([], []), np.zeros(0, int), params)
    wanted = spark.createDataFrame([(i,) for i in label], "doc_id long")
    found = sparse_features(docs.join(F.broadcast(wanted), "doc_id", "left_semi"), lambda t: text_features(t, params))
    rows = Rows([x for _, x, _ in found], [c for _, _, c in found])
    return train(rows, np.array([label[i] for i, _, _ in found], dtype=np.int64), params, share)


def classify(docs: DataFrame, model: QualityModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """Add the probability of class 1 to every row.  NULL text counts as empty;
    an empty text gets the bias alone; repeated rows get equal scores."""
    shared = docs.sparkSession.sparkContext.broadcast(model)    # one float per bucket
    return add_scores(docs, text_col, score_col, lambda: shared.value.scorer())


def quality_scores(docs: DataFrame, labels: DataFrame, params: QualityParams = QualityParams()) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    model = fit(docs.select("doc_id", "text"), labels.select("doc_id", "quality"), params)
    out = classify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score",
                      (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
