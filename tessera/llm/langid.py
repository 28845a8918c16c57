"""Language identification by a byte convolutional network, trained in numpy.

Bytes fold to symbols; filters of several widths run over fixed-length windows, are
max-pooled over each window and feed a softmax. A text's posterior is the mean over its
windows, weighted by their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.linear import free_prefix, score_texts, thinned
from tessera.session import materialize

WINDOW = 256
WIDTHS, FILTERS = (2, 4, 6), 8
#: Bounds of the training sample: distinct labelled texts, and the windows of all of them (whole texts beyond are left out).
MAX_TEXTS, MAX_WINDOWS, EPOCHS = 4000, 16_000, 4

#: Symbols: 0 padding, 1 blanks and controls, 2 digits, 3 signs, 4-29 letters, 30-93 continuation bytes, 94-125 lead bytes by their low bits.
SYMBOLS = np.full(256, 3, np.int32)
SYMBOLS[:33] = 1
SYMBOLS[48:58] = 2
SYMBOLS[65:91] = SYMBOLS[97:123] = np.arange(4, 30)
SYMBOLS[128:192] = np.arange(30, 94)
SYMBOLS[192:256] = 94 + np.arange(64) % 32
N_SYMBOLS = 126


@dataclass
class ByteCnn:
    """pairs[w]: tables (w / 2, N_SYMBOLS ** 2, FILTERS) of what two neighbouring symbols add to a filter."""

    langs: list[str]
    pairs: dict[int, np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def posteriors(self, windows: np.ndarray) -> np.ndarray:
        """(n, WINDOW) symbols to (n, languages)."""
        two = windows[:, :-1] * N_SYMBOLS + windows[:, 1:]
        pooled = []
        for w in WIDTHS:
            m = WINDOW - w + 1
            acc = self.pairs[w][0].take(two[:, :m], axis=0)
            for j in range(1, w // 2):
                acc += self.pairs[w][j].take(two[:, 2 * j : 2 * j + m], axis=0)
            pooled.append(acc.max(axis=1))
        h = np.maximum(np.concatenate(pooled, axis=1) + self.bias, 0)
        z = h @ self.out + self.out_bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def train(windows: np.ndarray, y: np.ndarray, langs: list[str], epochs: int = EPOCHS, seed: int = 7) -> ByteCnn:
    """Adam on the class-weighted cross-entropy; gradients flow through each filter's best position."""
    rng = np.random.default_rng(seed)
    k, total = len(langs), len(WIDTHS) * FILTERS
    p = {f"e{w}": rng.normal(0, 0.3, (w, N_SYMBOLS, FILTERS)).astype(np.float32) for w in WIDTHS}
    p |= {"b": np.zeros(total, np.float32), "o": rng.normal(0, 0.2, (total, k)).astype(np.float32), "c": np.zeros(k, np.float32)}
    m, v, t = {n: np.zeros_like(x) for n, x in p.items()}, {n: np.zeros_like(x) for n, x in p.items()}, 0
    share = np.bincount(y, minlength=k) / max(len(y), 1)
    weight = (1 / np.maximum(share, 1e-6) / k).clip(0, 20)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), 64):
            pick = order[at : at + 64]
            x, g = windows[pick], {n: np.zeros_like(a) for n, a in p.items()}
            pooled, best = [], {}
            for w in WIDTHS:
                n = WINDOW - w + 1
                acc = sum(p[f"e{w}"][j].take(x[:, j : j + n], axis=0) for j in range(w))
                best[w] = acc.argmax(axis=1)
                pooled.append(np.take_along_axis(acc, best[w][:, None], 1)[:, 0])
            pre = np.concatenate(pooled, axis=1) + p["b"]
            h = np.maximum(pre, 0)
            z = h @ p["o"] + p["c"]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            z /= z.sum(axis=1, keepdims=True)
            z[np.arange(len(pick)), y[pick]] -= 1
            z *= (weight[y[pick]] / len(pick))[:, None]
            g["o"], g["c"] = h.T @ z, z.sum(0)
            dh = (z @ p["o"].T) * (pre > 0)
            g["b"] = dh.sum(0)
            rows = np.arange(len(pick))[:, None]
            for i, w in enumerate(WIDTHS):
                d = dh[:, i * FILTERS : (i + 1) * FILTERS]
                for j in range(w):
                    np.add.at(g[f"e{w}"][j], (x[rows, best[w] + j], np.arange(FILTERS)[None]), d)
            t += 1
            for n in p:
                m[n] += 0.1 * (g[n] - m[n])
                v[n] += 0.001 * (g[n] ** 2 - v[n])
                p[n] -= 0.01 * (m[n] / (1 - 0.9**t)) / (np.sqrt(v[n] / (1 - 0.999**t)) + 1e-8)
    pairs = {w: np.stack([(p[f"e{w}"][2 * j][:, None] + p[f"e{w}"][2 * j + 1][None]).reshape(-1, FILTERS) for j in range(w // 2)]) for w in WIDTHS}
    return ByteCnn(langs, pairs, p["b"], p["o"], p["c"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, lang, text) to (h, lang, no, piece): all windows of each text, as bytes."""
    for b in batches:
        for h, lang, x in zip(b.column(0), b.column(1), b.column(2), strict=True):
            raw = x.as_buffer()
            starts = range(0, raw.size, WINDOW)
            pieces = [raw.slice(a, min(WINDOW, raw.size - a)).to_pybytes() for a in starts]
            yield pa.RecordBatch.from_arrays([pa.array([h.as_py()] * len(pieces), pa.int64()), pa.array([lang.as_py()] * len(pieces)), pa.array(range(len(pieces)), pa.int32()), pa.array(pieces, pa.binary())], names=["h", "lang", "no", "piece"])


def fit_langid(docs: DataFrame, keep: Column | None = None, max_texts: int = MAX_TEXTS, max_windows: int = MAX_WINDOWS) -> ByteCnn:
    """A network from the whole texts (non-empty, lang not null, `keep` holds) of the smallest hashes.

    Equal texts count once, in the first of their languages by name. At most max_texts are looked at; one whose windows
    would go beyond max_windows is left out whole. Without any text every prediction is "und".
    """
    keep = F.lit(True) if keep is None else keep
    rows = docs.where(F.col("lang").isNotNull() & (F.octet_length("text") > 0) & keep).select(F.xxhash64("text", F.lit(3)).alias("h"), "lang", "text")
    sizes = rows.groupBy("h").agg(F.min("lang").alias("lang"), F.max(F.ceil(F.octet_length("text") / WINDOW)).alias("n"))
    held, took = 0, []
    for r in thinned(materialize(sizes, "texts"), F.xxhash64("h"), max_texts).collect():
        if held + r.n <= max_windows:
            held += r.n
            took.append((r.h, r.lang))
    chosen = F.broadcast(docs.sparkSession.createDataFrame(took, "h long, lang string"))
    cut = rows.join(chosen, ["h", "lang"], "left_semi").mapInArrow(_windows, "h long, lang string, no int, piece binary")
    # Copies of a chosen text may stand thousands of times: their windows meet before they are collected.
    sample = cut.groupBy("h", "no").agg(F.min("lang").alias("lang"), F.min("piece").alias("piece")).orderBy("h", "no").toArrow()
    langs = sorted(set(sample["lang"].to_pylist()))
    windows = np.zeros((sample.num_rows, WINDOW), np.int32)
    for i, raw in enumerate(sample["piece"].to_pylist()):
        windows[i, : len(raw)] = SYMBOLS[np.frombuffer(raw, np.uint8)]
    y = np.array([langs.index(x) for x in sample["lang"].to_pylist()], np.int64)
    return train(windows, y, langs or ["und"])


def text_posteriors(model: ByteCnn, data: np.ndarray, offsets: np.ndarray, chunk: int = 256) -> np.ndarray:
    """(documents, languages): the mean posterior over all windows of each text, weighted by bytes."""
    size = np.diff(offsets)
    windows = -(-size // WINDOW)
    first = np.concatenate([[0], np.cumsum(windows)])
    doc = np.repeat(np.arange(len(size)), windows)
    start = offsets[doc] + (np.arange(first[-1]) - first[doc]) * WINDOW
    used = np.minimum(offsets[doc + 1] - start, WINDOW)
    symbols = np.concatenate([SYMBOLS[data], np.zeros(WINDOW, np.int32)])
    out = np.zeros((len(size), len(model.langs)))
    span = np.arange(WINDOW)
    for a in range(0, len(doc), chunk):
        s, u, d = start[a : a + chunk], used[a : a + chunk], doc[a : a + chunk]
        x = symbols[s[:, None] + span]
        x[span[None] >= u[:, None]] = 0
        p = model.posteriors(x) * u[:, None]
        for k in range(out.shape[1]):
            out[:, k] += np.bincount(d, weights=p[:, k], minlength=len(size))
    return out / np.maximum(size, 1)[:, None]


def predict_languages(docs: DataFrame, model: ByteCnn, columns: list[Column]) -> DataFrame:
    """`columns` of every row, lang_pred and score (its mean posterior) of the whole text.

    A null text, or one without any letter, is "und" with score 0. Ties go to the first language by name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rate(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        p = text_posteriors(shared.value, data, offsets)
        best = p.argmax(axis=1)
        return np.column_stack([best, p[np.arange(len(p)), best]])

    own = docs.select(*columns)
    mark, kept = free_prefix(own), own.columns
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias(mark + "letters")
    out = score_texts(docs, [*columns, letters], rate, [mark + "best", mark + "p"])
    names = F.array(*map(F.lit, model.langs))
    return out.select(
        *[F.col(f"`{c}`") for c in kept],
        F.when(F.col(mark + "letters"), names[F.col(mark + "best").cast("int")]).otherwise("und").alias("lang_pred"),
        F.when(F.col(mark + "letters"), F.least(F.col(mark + "p"), F.lit(1.0))).otherwise(0.0).alias("score"),
    )
