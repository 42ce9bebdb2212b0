"""Operator 7: toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; a sample of texts whose labels are not
looked at is the unlabelled set.  A linear classifier over hashed words is trained
in numpy on the class-prior-corrected risk

    prior * R_positive(+) + max(0, R_unlabelled(-) - prior * R_positive(-)),

and where the second part falls below zero the step goes the other way, which
keeps the estimate from over-fitting."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm.learning import Rows, WordMemory, add_scores, first_by_hash, fold, sigmoid, sparse_features, word_grams

# Fixed values of the contract: folds of labelled rows, the fold that is held out, the threshold.
FOLDS = 4
HELD_OUT = 2
THRESHOLD = 0.3

_WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class ToxicityParams:
    """``positives`` and ``unlabelled`` bound the sample that is learned from (all
    rows, if fewer); ``prior`` is the share of toxic texts (None: from the
    labels); ``least_texts``: features in fewer sample texts are not learned.

    Steps take large batches: in small ones the corrected risk falls below zero by chance."""

    positives: int = 3000
    unlabelled: int = 8000
    prior: float | None = None
    buckets: int = 1 << 18
    prefixes: tuple[int, ...] = (4, 5)
    least_texts: int = 4
    pick_epochs: int = 15
    fit_epochs: int = 100
    batch: int = 4000
    pick_rate: float = 0.1
    fit_rate: float = 0.2
    sparsity: float = 1e-3
    seed: int = 11


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def text_features(text: str, p: ToxicityParams) -> tuple[np.ndarray, np.ndarray]:
    """Buckets, and how many distinct words of the text fall in each: words and their
    beginnings (which carry the stem in languages that inflect at the end)."""
    feats, _ = word_grams(sorted(words_of(text)), p.buckets, prefixes=p.prefixes)
    ids, counts = np.unique(feats, return_counts=True)
    return ids, counts


@dataclass
class ToxicityModel:
    params: ToxicityParams
    weight: np.ndarray
    bias: float

    def scorer(self):
        p, weight, bias = self.params, self.weight, self.bias

        def figures(words: list[str]) -> np.ndarray:
            feats, owner = word_grams(words, p.buckets, prefixes=p.prefixes)
            return np.bincount(owner, weight[feats], len(words))

        memory = WordMemory(figures)

        def score(texts: list[str]) -> list[float]:
            return [float(sigmoid(bias + rows.sum())) for rows in memory.look_up([sorted(words_of(t)) for t in texts])]

        return score


def train(pos: Rows, unl: Rows, prior: float, p: ToxicityParams) -> ToxicityModel:
    """Sigmoid loss, AdaGrad steps, weights not below zero (evidence of toxicity
    adds up; the absence of it is the bias).  A first run with a proximal step
    picks the features that matter, a second one without it fits their weights.

    Without positives or unlabelled rows the answer is the prior."""
    full, bias = np.zeros(p.buckets), float(np.log(prior / (1 - prior)))
    if not len(pos) or not len(unl):
        return ToxicityModel(p, full, bias)
    texts = np.bincount(np.concatenate((pos.ids, unl.ids)), minlength=p.buckets)
    learned = np.flatnonzero(texts >= p.least_texts)
    for sparsity, epochs, rate in ((p.sparsity, p.pick_epochs, p.pick_rate), (0.0, p.fit_epochs, p.fit_rate)):
        weight, bias = _descend(pos, unl, prior, p, learned, sparsity, epochs, rate)
        full[:] = 0.0
        full[learned] = weight
        learned = np.flatnonzero(full)
    return ToxicityModel(p, full, bias)


def _descend(pos: Rows, unl: Rows, prior: float, p: ToxicityParams, learned: np.ndarray, sparsity: float, epochs: int,
             base_rate: float) -> tuple[np.ndarray, float]:
    """(weights of the learned buckets, bias) that lower the non-negative risk."""
    pos, unl = pos.only(learned, p.buckets), unl.only(learned, p.buckets)
    n = len(learned)
    weight, sum2 = np.zeros(n), np.full(n, 1e-6)
    bias, sum2_bias = float(np.log(prior / (1 - prior))), 1e-6
    rng = np.random.default_rng(p.seed)
    half = p.batch // 2

    def margins(rows: Rows, pick: np.ndarray):
        ids, counts, which = rows.take(pick)
        return ids, counts, which, np.bincount(which, counts * weight[ids], len(pick)) + bias

    for _ in range(epochs):
        order_u, order_p = rng.permutation(len(unl)), rng.permutation(len(pos))
        for lo in range(0, len(unl), half):
            u = order_u[lo:lo + half]
            q = np.take(order_p, np.arange(lo, lo + half), mode="wrap")
            iu, cu, wu, zu = margins(unl, u)
            ip, cp, wp, zp = margins(pos, q)
            su, sp = sigmoid(zu), sigmoid(zp)
            risk_negative = su.mean() - prior * sp.mean()
            slope_u, slope_p = su * (1 - su) / len(u), prior * sp * (1 - sp) / len(q)
            # The loss of a text as positive is sigmoid(-z), as negative sigmoid(z).
            du, dp = (slope_u, -2 * slope_p) if risk_negative >= 0 else (-slope_u, slope_p)
            grad = np.bincount(iu, cu * du[wu], n) + np.bincount(ip, cp * dp[wp], n)
            sum2 += grad * grad
            weight = np.maximum(weight - base_rate / np.sqrt(sum2) * (grad + sparsity), 0.0)
            g = float(du.sum() + dp.sum())
            sum2_bias += g * g
            bias -= base_rate * g / np.sqrt(sum2_bias)
    return weight, bias


def fit(docs: DataFrame, labels: DataFrame, params: ToxicityParams = ToxicityParams()) -> ToxicityModel:
    """Positives: rows labelled toxic outside the held-out fold.  Unlabelled: texts
    of the rows outside it that the label table names, their labels unseen, so that the
    toxic share of the table is the prior that the risk needs.

    Rows with a NULL id are left out; of repeated labels of an id, the largest counts."""
    learn = fold("doc_id", FOLDS) != HELD_OUT
    known = labels.where(learn).where("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = known.agg(F.avg("toxic")).first()[0]
    prior = params.prior if params.prior is not None else min(max(float(share or 0.0), 0.001), 0.5)
    pos = first_by_hash(known.where("toxic = 1").select("doc_id"), params.positives)
    unl = first_by_hash(known.select("doc_id"), params.unlabelled)
    pos_ids, unl_ids = ({r["doc_id"] for r in x.collect()} for x in (pos, unl))      # bounded by the parameters
    if not pos_ids or not unl_ids:
        return train(Rows([], []), Rows([], []), prior, params)
    wanted = docs.sparkSession.createDataFrame([(i,) for i in sorted(pos_ids | unl_ids)], "doc_id long")
    found = sparse_features(docs.join(F.broadcast(wanted), "doc_id", "left_semi"), lambda t: text_features(t, params))
    parts = [Rows([x for i, x, _ in found if i in ids], [c for i, _, c in found if i in ids]) for ids in (pos_ids, unl_ids)]
    return train(*parts, prior, params)


def classify(docs: DataFrame, model: ToxicityModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """Add the probability of being toxic to every row.  NULL text counts as empty;
    an empty text gets the bias alone; repeated rows get equal scores."""
    shared = docs.sparkSession.sparkContext.broadcast(model)    # one float per bucket
    return add_scores(docs, text_col, score_col, lambda: shared.value.scorer())


def toxicity_scores(docs: DataFrame, labels: DataFrame, params: ToxicityParams = ToxicityParams()) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    model = fit(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"), params)
    out = classify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score",
                      (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
