"""Mixing to target weights by soft membership.

Classifiers trained on the labelled table give each document a posterior over domains.
Nonnegative document rates then minimise the squared distance between the expected tokens
of each domain and its target, with a small weight on staying near 1, by accelerated
projected-gradient steps: each step moves every rate against its posterior times the
residuals of the domains and projects it to zero or more. A rate therefore follows from the
document's posterior and the residuals of all steps: a few numbers a step are all the
state, each step is one distributed sum over cells of equal posteriors, in which the last
steps are replayed on rates that are written down now and then, so that every step costs the
same, and a lost executor costs nothing but its part of that sum.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tessera.llm import textkit as tk
from tessera.llm.linear import score_texts, sigmoid, word_ngrams, word_presence
from tessera.llm.quality import fit_quality
from tessera.llm.toxicity import fit_toxicity
from tessera.session import discard, materialize

#: Domains by the labels: toxic before quality. Default targets are shares of the expected tokens.
DOMAINS = ("good", "poor", "toxic")
TARGETS = {"good": 0.80, "poor": 0.15, "toxic": 0.05}
#: Steps that are replayed at most before the cells' rates are written down.
WRITTEN = 32
#: Steps at most, the length of a projected step (root mean square over tokens, before it is scaled) at which they end, and the weight of staying near 1.
STEPS, TOLERANCE, RIDGE = 1000, 5e-5, 3e-5


@dataclass
class DomainModel:
    """The quality and toxicity models: good and poor share what is not toxic."""

    quality: np.ndarray
    bias: float
    toxicity: np.ndarray
    threshold: float

    def posteriors(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        f, d = word_ngrams(data, offsets)
        mean = np.bincount(d, weights=self.quality[f].astype(np.float64), minlength=n) / np.maximum(np.bincount(d, minlength=n), 1)
        good = sigmoid(mean + self.bias)
        f, d = word_presence(data, offsets)
        toxic = sigmoid(np.bincount(d, weights=self.toxicity[f].astype(np.float64), minlength=n) - self.threshold)
        # In whole thousandths that sum to 1: the second follows from the others.
        toxic, good = np.rint(toxic * 1000), np.rint((1 - toxic) * good * 1000)
        return np.column_stack([good, np.maximum(1000 - toxic - good, 0), toxic]) / 1000


def fit_domains(docs: DataFrame, labels: DataFrame) -> DomainModel:
    """Both models from bounded samples of the labelled rows (see their modules)."""
    weights, bias = fit_quality(docs, labels)
    ordinal = fit_toxicity(docs, labels)
    return DomainModel(weights, bias, ordinal.weights, float(ordinal.thresholds[0]))


def with_posteriors(docs: DataFrame, model: DomainModel, columns: list[Column] | None = None, prefix: str = "p_") -> DataFrame:
    """Columns (all if None), the posterior of each domain in thousandths (so that there are at most 501,501 cells), and `{prefix}tokens`, the words of the text.

    Null and empty texts have no tokens and the posterior of the models' intercepts.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rate(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        words = np.bincount(tk.word_spans(data, offsets, tk.NOT_BLANK)[2], minlength=len(offsets) - 1)
        return np.column_stack([shared.value.posteriors(data, offsets), words])

    return score_texts(docs, columns, rate, [prefix + c for c in (*DOMAINS, "tokens")])


@dataclass
class Rates:
    """The steps of a fit: the residuals of the domains and the momentum of each; and whether the last one met the tolerance."""

    size: float
    steps: list[tuple[np.ndarray, float]]
    converged: bool = False

    def replay(self, p: np.ndarray, rate: np.ndarray | None = None, before: np.ndarray | None = None, done: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of posteriors (n, domains): the rates, those of the step before, and the last change; from the rates after `done` steps, if given."""
        rate = np.ones(len(p)) if rate is None else rate
        before = rate if before is None else before
        last = np.zeros(len(p))
        for residual, momentum in self.steps[done:]:
            at = rate + momentum * (rate - before)
            new = np.maximum(at - self.size * (p @ residual + RIDGE * (at - 1)), 0.0)
            before, rate, last = rate, new, new - at
        return rate, before, last


def fit_rates(scored: DataFrame, targets: dict[str, float], budget: float = 1.0, prefix: str = "p_", steps: int = STEPS) -> Rates:
    """Rates that bring the domains' expected tokens to the targets, which are shares of `budget` times all tokens.

    Steps end when the projected step is shorter than TOLERANCE, at which the objective's gradient is met up to that
    length; targets that no rates can meet end at the least squares. After `steps` steps `converged` stays false and a
    warning says so. No tokens: rates of 1.
    """
    names = [prefix + c for c in DOMAINS]
    one = F.lit(1.0)
    cells = materialize(scored.groupBy(*names).agg(F.sum(prefix + "tokens").alias("t")).repartition(4).select(*names, "t", one.alias("rate"), one.alias("before")), "cells")
    done = 0
    k = len(DOMAINS)
    share = np.array([targets.get(c, 0.0) for c in DOMAINS])
    goal = share / share.sum() * budget
    total = cells.agg(F.sum("t"), *(F.sum(F.col("t") * F.col(x) * F.col(y)) for x in names for y in names)).first()
    if not total[0]:
        return Rates(1.0, [], True)
    gram = np.array(total[1:], float).reshape(k, k) / total[0]
    rates = Rates(1.0 / (np.linalg.eigvalsh(gram)[-1] + RIDGE), [])
    age, best = 1.0, np.inf

    def sums(momentum: float) -> np.ndarray:
        """Per token: expected tokens of each domain at the rates and at the next point, the ridge's sum, and the square of the last step."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                *p, t, r, before = (np.asarray(b.column(i), float) for i in range(k + 3))
                p = np.column_stack(p)
                r, before, last = rates.replay(p, r, before, done)
                out = [*((t * r) @ p), *((t * (r + momentum * (r - before))) @ p), t @ (r - 1) ** 2, t @ last**2]
                yield pa.RecordBatch.from_arrays([pa.array([float(x)]) for x in out], names=columns)

        columns = [f"s{i}" for i in range(2 * k + 2)]
        # A row for each batch of cells, of which there are a bounded number.
        part = cells.mapInArrow(run, ", ".join(f"{c} double" for c in columns)).toArrow()
        return np.array([sum(part[c].to_pylist()) for c in columns]) / total[0]

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            *p, t, r, before = (np.asarray(b.column(i), float) for i in range(k + 3))
            r, before, _ = rates.replay(np.column_stack(p), r, before, done)
            yield pa.RecordBatch.from_arrays([*b.columns[: k + 1], pa.array(r), pa.array(before)], names=b.schema.names)

    for _ in range(steps):
        if len(rates.steps) - done > WRITTEN:
            # The last step stays to be replayed, as its length is asked for.
            last = rates.steps.pop()
            older_cells, cells = cells, materialize(cells.mapInArrow(written, cells.schema), "cells")
            discard(older_cells)
            done = len(rates.steps)
            rates.steps.append(last)
        older = (1 + np.sqrt(1 + 4 * age * age)) / 2
        momentum = (age - 1) / older if rates.steps else 0.0
        got = sums(momentum)
        if rates.steps and np.sqrt(got[2 * k + 1]) < TOLERANCE:
            rates.converged = True
            break
        value = ((got[:k] - goal) ** 2).sum() / 2 + RIDGE / 2 * got[2 * k]
        if value > best:  # the momentum overshot: start anew from here without it
            age, older, momentum = 1.0, (1 + np.sqrt(5)) / 2, 0.0
            got[k : 2 * k] = got[:k]
        best, age = value, older
        rates.steps.append((got[k : 2 * k] - goal, momentum))
    if not rates.converged:
        warnings.warn(f"the mixing rates still move after {steps} steps", stacklevel=2)
    discard(cells)
    return rates


def with_rates(scored: DataFrame, rates: Rates, prefix: str = "p_") -> DataFrame:
    """The table with `{prefix}rate`, rounded to six places, of each row's posterior."""
    names = [prefix + c for c in DOMAINS]
    fields = scored.schema.fields
    shared = scored.sparkSession.sparkContext.broadcast(rates)
    places = [scored.columns.index(c) for c in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p, of = np.unique(np.column_stack([np.asarray(b.column(i), float) for i in places]), axis=0, return_inverse=True)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.round(shared.value.replay(p)[0], 6)[of.ravel()])], names=[*b.schema.names, prefix + "rate"])

    return scored.mapInArrow(run, StructType([*fields, StructField(prefix + "rate", DoubleType())]))


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, budget: float = 1.0, columns: list[Column] | None = None, prefix: str = "p_", learn: DataFrame | None = None) -> DataFrame:
    """Columns (all if None), posteriors, tokens, `{prefix}rate`, and `{prefix}copies`: the whole part of the
    rate, and one more with the chance of the rest, drawn by the hash of doc_id and text. Rows with
    equal posteriors have equal rates; repeated rows are each drawn alike. Empty table: no rows.
    The classifiers are learnt from the texts of `learn`, by default of the table itself."""
    model = fit_domains(docs if learn is None else learn, labels)
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit(29)), F.lit(1_000_000)).alias(prefix + "draw")
    columns = [F.col(f"`{c}`") for c in docs.columns] if columns is None else columns
    scored = materialize(with_posteriors(docs, model, [*columns, draw], prefix), "posteriors")
    out = with_rates(scored, fit_rates(scored, targets or TARGETS, budget, prefix), prefix)
    rate = F.col(prefix + "rate")
    return out.withColumn(prefix + "copies", (F.floor(rate) + (F.col(prefix + "draw") < (rate - F.floor(rate)) * 1_000_000).cast("int")).cast("int")).drop(prefix + "draw")
