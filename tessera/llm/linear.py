"""Sparse text features and the follow-the-regularised-leader core of the linear models."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tessera.llm import textkit as tk
from tessera.session import discard, materialize

U64 = tk.U64
BITS = 18
DIM = 1 << BITS
#: Rows of a training sample at the very most, where doc_ids repeat.
MAX_SAMPLE = 20_000

#: 0 blank and control, 1 letter or digit or non-ASCII, 2 other.
_KIND = np.full(256, 2, np.uint8)
_KIND[: 0x21] = 0
_KIND[0x7F] = 0
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _KIND[_a:_b] = 1
_UPPER = np.zeros(256, np.int32)
_UPPER[65:91] = 1
_HIGH = np.zeros(256, np.int32)
_HIGH[128:] = 1


def token_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of every run of word bytes or of other visible bytes."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    kind = _KIND[data]
    edge = np.ones(n + 1, bool)
    edge[1:n] = kind[1:] != kind[:-1]
    edge[offsets] = True
    at = np.flatnonzero(edge)
    s, e = at[:-1], at[1:]
    seen = kind[s] > 0
    s, e = s[seen], e[seen]
    return s, e, np.searchsorted(offsets, s, side="right") - 1


def word_ngrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of a block, one for each occurrence: words, word pairs, a mark for a
    word that repeats at once, and triples of word shapes (case, digits, signs). With documents."""
    s, e, d = token_spans(data, offsets)
    if not len(s):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = tk.span_hashes(data, s, e, True)
    up, high = (np.concatenate([[0], np.cumsum(t[data])]) for t in (_UPPER, _HIGH))
    ups, highs, size = up[e] - up[s], high[e] - high[s], e - s
    kind = _KIND[data[s]]
    digit = (data[s] >= 48) & (data[s] < 58)
    shape = np.select([kind == 2, digit, (ups + highs == size) & (ups > 1), ups == 0, ups == 1], [np.minimum(size, 3), 4, 5, 6, 7], 8).astype(U64)
    pair = d[1:] == d[:-1]
    twice = pair & (h[1:] == h[:-1])
    three = (d[2:] == d[:-2]) if len(d) > 2 else np.zeros(0, bool)
    triple = (shape[:-2] * U64(100) + shape[1:-1] * U64(10) + shape[2:])[three] if len(d) > 2 else np.zeros(0, U64)
    hashes = [h, tk.mix64(h[:-1] * U64(0xC2B2AE3D27D4EB4F) + h[1:])[pair], np.full(int(twice.sum()), 77, U64), tk.mix64(triple + U64(1 << 40))]
    docs = [d, d[1:][pair], d[1:][twice], d[2:][three] if len(d) > 2 else d[:0]]
    return (np.concatenate(hashes) & U64(DIM - 1)).astype(np.int64), np.concatenate(docs)


def word_presence(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed words of each document, case folded."""
    h, d = tk.word_hashes(data, offsets, _KIND == 1)
    h, d, _ = tk.sorted_sets(h & U64(DIM - 1), d, len(offsets) - 1)
    return h.astype(np.int64), d


def free_prefix(df: DataFrame) -> str:
    """A prefix that no column of the table begins with."""
    p = "__"
    while any(c.lower().startswith(p) for c in df.columns):
        p += "_"
    return p


def held(key: str, mod: int, rest: int) -> Column:
    """Whether crc32 of the key as text leaves this remainder; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % mod == rest


def by_block(text: pa.Array, limit: int = tk.BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Range of documents, bytes and offsets of each block of a text column."""
    data, offsets = tk.raw_text(text)
    for i, j in tk.blocks(offsets, limit):
        lo, hi = offsets[i], offsets[j]
        yield i, j, data[lo:hi], offsets[i : j + 1] - lo


def score_texts(docs: DataFrame, columns: list[Column], rate: Callable[[np.ndarray, np.ndarray], np.ndarray], names: list[str]) -> DataFrame:
    """columns of every row, then what `rate` gives for each text: an array of (documents, len(names)).

    Whole texts go through in blocks of documents; the rows stay where they were read.
    """
    frame = docs.select(*columns)
    at = frame.columns.index("text") if "text" in frame.columns else len(frame.columns)
    kept = frame.schema.fields
    if at == len(kept):
        frame = docs.select(*columns, F.col("text").alias(free_prefix(frame) + "text"))
    schema = StructType([*kept, *(StructField(n, DoubleType()) for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.zeros((b.num_rows, len(names)))
            for i, j, data, offsets in by_block(b.column(at)):
                out[i:j] = rate(data, offsets)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], *(pa.array(out[:, k]) for k in range(len(names)))], names=[f.name for f in kept] + names)

    return frame.mapInArrow(run, schema)


def thinned(rows: DataFrame, place: Column, limit: int) -> DataFrame:
    """The `limit` rows of the smallest places (`place`: a hash column of the rows), ties by all columns.

    Rows far beyond the limit's share of the count are left out first, so that the one task which
    takes the limit reads a few times `limit` rows, however many partitions there are.
    """
    top = 1_000_000_007
    share = (4 * limit + 1000) / max(rows.count(), 1)
    held = rows.withColumn("__place", F.pmod(place, F.lit(top)))
    if share < 1:
        held = held.where(F.col("__place") < int(top * share))
    return held.orderBy("__place", *rows.columns).limit(limit).drop("__place")


def sample_labels(labels: DataFrame, target: Column, keep: Column, limit: int) -> DataFrame:
    """At most `limit` labelled keys, those of the smallest hashes: a fixed random sample."""
    rows = labels.where(F.col("doc_id").isNotNull() & keep).select("doc_id", target.cast("int").alias("y")).where("y is not null")
    return thinned(rows, F.xxhash64("doc_id", F.lit(17)), limit)


def gather(docs: DataFrame, sample: DataFrame, features: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], most: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(y, distinct features, relative counts) of the sampled rows, in a fixed random order, each with all its features.

    Rows are taken in that order as long as they have `most` features in all; one that would go beyond is
    left out whole. `sample` has a bounded number of rows and is therefore broadcast.
    """
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "y", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got: list[list] = [[], [], []]
            for i, j, data, offsets in by_block(b.column(2)):
                f, d = features(data, offsets)
                order = np.argsort(d, kind="stable")
                f, bounds = f[order], np.searchsorted(d[order], np.arange(j - i + 1))
                for x, y in zip(bounds[:-1], bounds[1:], strict=True):
                    u, c = np.unique(f[x:y], return_counts=True)
                    got[0].append(len(u))
                    got[1].append(u.astype(np.int32))
                    got[2].append((c / max(y - x, 1)).astype(np.float32))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got[0], pa.int64()), pa.array(got[1], pa.list_(pa.int32())), pa.array(got[2], pa.list_(pa.float32()))], names=["doc_id", "y", "n", "f", "c"])

    seen = rows.mapInArrow(run, "doc_id long, y int, n long, f array<int>, c array<float>").withColumn("at", F.xxhash64("doc_id", F.lit(31)))
    seen = materialize(seen.withColumn("what", F.xxhash64("f", "c", "y")), "features")
    # A row of the sample may stand more than once under its doc_id: equal ones count once.
    size = seen.groupBy("at", "what").agg(F.max("n").alias("n")).orderBy("at", "what").limit(MAX_SAMPLE).toArrow()
    held, took = 0, []
    for at, what, n in zip(*(size[c].to_pylist() for c in ("at", "what", "n")), strict=True):
        if held + n <= most:
            held += n
            took.append((at, what))
    chosen = docs.sparkSession.createDataFrame(took, "at long, what long")
    # Repeated rows are dropped before they are collected: what the driver takes is bounded by `most`, however often a row stands.
    table = seen.join(F.broadcast(chosen), ["at", "what"], "left_semi").select("at", "what", "y", "f", "c").dropDuplicates(["at", "what"]).toArrow()
    discard(seen)
    lists = [[np.asarray(x.values) for x in table[name]] for name in ("f", "c")]
    out = {(at, what): (y, f, c) for at, what, y, f, c in zip(*(table[c].to_pylist() for c in ("at", "what", "y")), *lists, strict=True)}
    return [out[k] for k in sorted(out)]


class Ftrl:
    """Follow-the-regularised-leader (proximal) state of one weight vector per output."""

    def __init__(self, outputs: int = 1, dim: int = DIM, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.0, l2: float = 1e-3):
        self.z, self.n = np.zeros((outputs, dim)), np.zeros((outputs, dim))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, f: np.ndarray | slice = slice(None), k: int = 0) -> np.ndarray:
        z, n = self.z[k, f], self.n[k, f]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def step(self, f: np.ndarray, w: np.ndarray, g: np.ndarray, k: int = 0) -> None:
        n = self.n[k, f]
        grown = n + g * g
        self.z[k, f] += g - (np.sqrt(grown) - np.sqrt(n)) / self.alpha * w
        self.n[k, f] = grown


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))
