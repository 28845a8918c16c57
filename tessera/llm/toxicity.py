"""Toxicity by cumulative-link ordinal regression over sparse word features.

P(grade > k) is a logistic function of one shared score minus an ordered threshold.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.linear import DIM, Ftrl, gather, sample_labels, score_texts, sigmoid, word_presence

#: Bounds of the training sample: labelled rows, and the features of all of them (whole rows beyond are left out). Only words of at least MIN_TEXTS sampled
#: texts whose presence has a chi-square of at least MIN_CHI against toxicity are fitted; copies count once.
MAX_ROWS, MAX_FEATURES, EPOCHS, MIN_TEXTS, MIN_CHI = 8000, 6_000_000, 8, 4, 12.0
#: Grades: 0 clean; 1 toxic in a text of good quality; 2 toxic in one of bad quality, or of none stated.
GRADES = 3


def severity_label() -> Column:
    return F.when(F.col("toxic") == 0, 0).when(F.col("toxic") == 1, F.when(F.col("quality") == 1, 1).otherwise(2))


@dataclass
class Ordinal:
    weights: np.ndarray
    thresholds: np.ndarray
    cut: float


def best_cut(toxic: np.ndarray, severity: np.ndarray) -> float:
    """The least severity to be flagged: midway at the split of the training rows with the highest F1."""
    order = np.argsort(-severity, kind="stable")
    s, hit = severity[order], np.cumsum(toxic[order])
    f1 = 2 * hit / (np.arange(1, len(s) + 1) + max(toxic.sum(), 1))
    f1[:-1][s[:-1] == s[1:]] = -1
    k = int(np.argmax(f1))
    return float((s[k] + s[k + 1]) / 2) if k + 1 < len(s) else float(s[k])


def fit_toxicity(docs: DataFrame, labels: DataFrame, keep: Column | None = None, max_rows: int = MAX_ROWS) -> Ordinal:
    """Shared weights and ordered thresholds from up to max_rows labelled rows for which `keep` holds.

    Rows without a toxic label are not used. Without any row every text is graded 0.
    """
    keep = F.lit(True) if keep is None else keep
    rows = gather(docs, sample_labels(labels, severity_label(), keep, max_rows), word_presence, MAX_FEATURES)
    rows = list({(y, f.tobytes()): (y, f) for y, f, _ in rows}.values())
    seen = np.zeros((2, DIM))
    for y, f in rows:
        seen[int(y > 0), f] += 1
    total = np.array([sum(y == 0 for y, _ in rows), sum(y > 0 for y, _ in rows)], float)
    both = seen.sum(0)
    expected = both * total[1] / max(total.sum(), 1)
    chi = (seen[1] - expected) ** 2 * (1 / np.maximum(expected, 1e-9) + 1 / np.maximum(both - expected, 1e-9))
    fitted = (both >= MIN_TEXTS) & (chi >= MIN_CHI)
    rows = [(y, f[fitted[f]]) for y, f in rows]
    if not rows:
        return Ordinal(np.zeros(DIM, np.float32), np.array([9.0, 18.0]), 1.0)
    model = Ftrl(alpha=0.5, l1=3.0, l2=1e-3)
    cut = np.array([2.0, 1.0])  # the first threshold, and the log of each further step
    sums = np.full(2, 1e-8)
    for _ in range(EPOCHS):
        for y, f in rows:
            w = model.weights(f)
            theta = np.cumsum(np.concatenate([cut[:1], np.exp(cut[1:])]))
            over = sigmoid(w.sum() - theta)
            above = np.concatenate([[1.0], over, [0.0]])
            slope = np.concatenate([[0.0], over * (1 - over), [0.0]])
            p = max(above[y] - above[y + 1], 1e-9)
            per = np.zeros(GRADES + 1)  # of the log-likelihood by each P(grade > k)'s argument
            per[y], per[y + 1] = slope[y] / p, -slope[y + 1] / p
            g = -per.sum()
            model.step(f, w, np.full(len(f), g))
            t = per[1:GRADES]  # raising a threshold lowers its argument
            grad = np.array([t.sum(), t[1] * np.exp(cut[1])])
            sums += grad * grad
            cut -= 0.3 * grad / np.sqrt(sums)
    theta, w = np.cumsum(np.concatenate([cut[:1], np.exp(cut[1:])])), model.weights().astype(np.float32)
    severity = np.array([sigmoid(w[f].astype(float).sum() - theta).sum() for _, f in rows])
    return Ordinal(w, theta, best_cut(np.array([y > 0 for y, _ in rows]), severity))


def score_toxicity(docs: DataFrame, model: Ordinal, columns: list[Column]) -> DataFrame:
    """`columns` of every row, p_1 and p_2 (probabilities of a grade of at least 1, 2), severity (the
    expected grade, 0 to 2), grade (the median one) and toxic (whether severity reaches the model's cut). Null and empty texts
    have no features: the thresholds alone decide."""
    shared = docs.sparkSession.sparkContext.broadcast(model.weights)
    theta = model.thresholds

    def rate(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        f, d = word_presence(data, offsets)
        eta = np.bincount(d, weights=shared.value[f].astype(np.float64), minlength=len(offsets) - 1)
        return sigmoid(eta[:, None] - theta[None, :])

    out = score_texts(docs, columns, rate, ["p_1", "p_2"])
    out = out.withColumn("severity", F.col("p_1") + F.col("p_2")).withColumn("toxic", F.col("severity") >= model.cut)
    return out.withColumn("grade", (F.col("p_1") >= 0.5).cast("int") + (F.col("p_2") >= 0.5).cast("int"))
