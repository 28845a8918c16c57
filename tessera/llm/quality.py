"""Quality classifier: hashed word n-gram logistic regression, trained by follow-the-regularised-leader updates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.linear import Ftrl, gather, sample_labels, score_texts, sigmoid, word_ngrams

#: Bounds of the training sample: labelled rows, and the features of all of them (whole rows beyond are left out). A text's relative frequencies are scaled by SCALE.
MAX_ROWS, MAX_FEATURES, EPOCHS, SCALE = 6000, 6_000_000, 4, 20.0


def fit_quality(docs: DataFrame, labels: DataFrame, keep: Column | None = None, max_rows: int = MAX_ROWS) -> tuple[np.ndarray, float]:
    """Weights and intercept from up to max_rows labelled rows for which `keep` holds (all by default).

    Without any labelled row the weights are zero and every score is 0.5.
    """
    keep = F.lit(True) if keep is None else keep
    rows = gather(docs, sample_labels(labels, F.col("quality"), keep, max_rows), word_ngrams, MAX_FEATURES)
    model, bias = Ftrl(l1=0.02), Ftrl(dim=1)
    one = np.zeros(1, np.int64)
    for _ in range(EPOCHS):
        for y, f, x in rows:
            x = x * SCALE
            w, b = model.weights(f), bias.weights(one)
            g = float(sigmoid(w @ x + b[0])) - (y > 0)
            model.step(f, w, g * x)
            bias.step(one, b, np.array([g]))
    return (model.weights() * SCALE).astype(np.float32), float(bias.weights(one)[0])


def score_quality(docs: DataFrame, weights: np.ndarray, bias: float, columns: list[Column], name: str = "score") -> DataFrame:
    """`columns` of every row and the probability of label 1 of its whole text: the sparse dot product of
    its relative n-gram frequencies. Null and empty texts score by the intercept alone."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def rate(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        f, d = word_ngrams(data, offsets)
        n = len(offsets) - 1
        total = np.bincount(d, weights=shared.value[f].astype(np.float64), minlength=n)
        return sigmoid(total / np.maximum(np.bincount(d, minlength=n), 1) + bias)[:, None]

    return score_texts(docs, columns, rate, [name])
