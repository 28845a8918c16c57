"""Removal of repeated byte strings: a suffix order that is only as deep as the threshold.

Suffixes are ordered by most-significant-digit passes, and only through `length` bytes, so
the groups that stay equal are exactly the repeated windows. A digit is a run of bytes,
represented by a 64-bit hash. The digits are chosen so that few suffixes need more than
the first pass:

1. Every window of `length` bytes has one anchor, the place of the smallest hash among its
   positions but the last quarter; it depends on the window's bytes alone. The first digit
   is the quarter of a window that begins at the anchor. Neighbouring windows share
   anchors. Anchors whose digit occurs once drop out with all their windows.
2. The next digit is the whole stretch of bytes under the windows of one anchor. All but a
   stretch's first occurrence are removed whole.
3. First occurrences of different stretches around one anchor may still share windows. The
   windows of a stretch are taken a few at a time (a bin), by their distance from the
   anchor; the bytes that all of these hold are the third digit, and what occurs once drops
   out. Bins whose bytes are equal throughout are again removed whole but for the first.
4. Only bins that differ are ordered to the full depth, window by window.

Equality is of hashes, not of bytes: polynomials modulo a prime of 31 bits at two bases. The
digits share bases, so the window's hash decides alone: two different windows of one piece
agree with a chance of about 2 ** -62, and of at most ((length + 1) / 2 ** 31) ** 2 for bytes
chosen against it. n windows of one piece hold a false pair with a chance of about n ** 2 / 2 ** 63.

Groups are summed to their smallest document before the exchange and joined back, so a
string that stands in a third of all texts is never gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import textkit as tk
from tessera.llm.linear import by_block
from tessera.session import discard, materialize

U64 = tk.U64
#: Windows that are ordered together in the third pass: this part of the length, sixteen of a hundred.
BIN_PART = 6
#: A null doc_id stands before all others.
FIRST = -(1 << 63)
_SPREAD, _HIGH = U64(0x9FB21C651E98DF25), U64(0xFFFFFFFF00000000)


def _rows(docs: DataFrame) -> DataFrame:
    """doc, rid (stands for the text and its length) and text; null texts are empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST)).alias("doc"), F.xxhash64(text, F.octet_length(text)).alias("rid"), text.alias("text"))


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbours, by doubling."""
    step, out = 1, v
    while 2 * step <= w:
        out = np.minimum(out[:-step], out[step:])
        step *= 2
    rest = w - step
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def stretches(data: np.ndarray, offsets: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """Per anchor of a block, in order: document, lo and hi (first and last window start), at (the anchor), gram and stretch hashes."""
    gram, n = max(1, length // 4), len(data)
    if n < length:
        z = np.zeros(0, np.int64)
        return {"doc": z, "lo": z, "hi": z, "at": z, "gram": z.astype(U64), "whole": z.astype(U64)}
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = data
    # Up to eight bytes at each position, spread over 32 bits, and below them the position: the smallest is the leftmost of equals.
    key = np.ndarray((n - gram + 1,), "<u8", padded, strides=(1,))
    key = (key & U64((1 << 8 * gram) - 1) if gram < 8 else key) * _SPREAD
    key &= _HIGH
    key |= np.arange(len(key), dtype=U64)
    anchor = (sliding_min(key, length - gram + 1) & ~_HIGH).astype(np.int64)
    inside = np.zeros(len(anchor) + 1, np.int8)  # window starts that stay within a document
    size = np.diff(offsets)
    long = size >= length
    np.add.at(inside, offsets[:-1][long], 1)
    np.add.at(inside, offsets[:-1][long] + size[long] - length + 1, -1)
    inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    first, last = inside.copy(), inside.copy()
    first[1:] &= (anchor[1:] != anchor[:-1]) | ~inside[:-1]
    last[:-1] &= first[1:] | ~inside[1:]
    lo, hi = np.flatnonzero(first), np.flatnonzero(last)
    a = anchor[lo]
    prefix = tk.prefix_hash(data)
    whole = tk.mix64(tk.range_hash(prefix, lo, hi + length) + (a - lo).astype(U64) * _SPREAD + (hi - lo).astype(U64))
    return {"doc": np.searchsorted(offsets, lo, side="right") - 1, "lo": lo, "hi": hi, "at": a, "gram": tk.range_hash(prefix, a, a + gram), "whole": whole}


def first_of(doc: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Whether a row is the first of its document with these keys."""
    order = np.lexsort((*keys, doc))  # stable: equal keys keep their order
    same = np.ones(max(len(doc) - 1, 0), bool)
    for k in (doc, *keys):
        same &= k[order][1:] == k[order][:-1]
    out = np.ones(len(doc), bool)
    out[order[1:][same]] = False
    return out


def _grams(rows: DataFrame, length: int) -> DataFrame:
    """The anchors' grams that occur more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, data, offsets in by_block(b.column(0)):
                g, n = np.unique(stretches(data, offsets, length)["gram"], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(n.astype(np.int32))], names=["gram", "n"])

    return rows.select("text").mapInArrow(run, "gram long, n int").groupBy("gram").agg(F.sum("n").alias("n")).where("n > 1").select("gram")


def _stretches(rows: DataFrame, length: int) -> DataFrame:
    """gram, whole, doc, rid, lo, hi, at, again of the first place of each stretch in each text (again false), and of
    the runs of stretches that their own text has earlier (again true; the gram is that of the run's first)."""
    names = ["gram", "whole", "doc", "rid", "lo", "hi", "at", "again"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, rid = (b.column(i).to_numpy() for i in range(2))
            for i, _, data, offsets in by_block(b.column(2)):
                s = stretches(data, offsets, length)
                d, lo, hi = s["doc"], s["lo"], s["hi"]
                keep = first_of(d, s["whole"], s["gram"])
                again = ~keep
                follows = np.zeros(len(d), bool)  # goes on with the run of the stretch before
                follows[1:] = again[1:] & again[:-1] & (d[1:] == d[:-1]) & (lo[1:] == hi[:-1] + 1)
                begins = again & ~follows
                ends = again.copy()
                ends[:-1] &= ~follows[1:]
                at = np.flatnonzero(keep | begins)
                until = hi.copy()
                until[begins] = hi[ends]
                d, base = d[at], offsets[d[at]]
                out = [s["gram"][at].view(np.int64), s["whole"][at].view(np.int64), doc[i + d], rid[i + d], *((x[at] - base).astype(np.int32) for x in (lo, until, s["at"])), again[at]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=names)

    return rows.mapInArrow(run, "gram long, whole long, doc long, rid long, lo int, hi int, at int, again boolean")


def _bins(rows: DataFrame, found: DataFrame, length: int) -> DataFrame:
    """The bins of the given stretches: piece (gram, bin and the bytes that all its windows hold), full (all its bytes), doc, rid,
    lo, hi, windows (hash of each, null where its text has it earlier), again (the whole bin is earlier in its text)."""
    width = max(1, length // BIN_PART)
    names = ["piece", "full", "doc", "rid", "lo", "hi", "windows", "again"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offsets in by_block(b.column(2)):
                ids = [b.column(c).slice(i, j - i).to_numpy() for c in range(2)]
                per = b.column(3).slice(i, j - i).value_lengths().to_numpy()
                doc = np.repeat(np.arange(j - i), per)
                gram, lo, hi, at = (np.asarray(b.column(c).slice(i, j - i).flatten()).astype(np.int64) for c in range(3, 7))
                lo, hi, at = (x + offsets[doc] for x in (lo, hi, at))
                order = np.argsort(lo)
                doc, gram, lo, hi, at = (x[order] for x in (doc, gram, lo, hi, at))
                # Bins of a stretch in the order of their windows: from the farthest before the anchor on.
                far, near = (at - lo) // width, (at - hi) // width
                count = far - near + 1
                of = np.repeat(np.arange(len(lo)), count)
                k = far[of] - (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
                doc, a = doc[of], at[of]
                lows, highs = np.maximum(lo[of], a - width * (k + 1) + 1), np.minimum(hi[of], a - width * k)
                prefix = tk.prefix_hash(data)
                shared = tk.range_hash(prefix, a - width * k, a - width * (k + 1) + 1 + length)
                piece = tk.mix64(tk.mix64(gram[of].view(U64) + k.astype(U64) * _SPREAD) ^ shared)
                full = tk.mix64(tk.range_hash(prefix, lows, highs + length) + (a - lows).astype(U64) * _SPREAD + (highs - lows).astype(U64))
                again = ~first_of(doc, full, piece)
                n = highs - lows + 1
                ends = np.cumsum(n)
                bin_ = np.repeat(np.arange(len(of)), n)
                start = np.arange(len(bin_)) - (ends - n)[bin_] + lows[bin_]
                w = tk.range_hash(prefix, start, start + length)
                seen = ~first_of(doc[bin_], w, piece[bin_])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(w.view(np.int64), mask=seen))
                columns = [piece.view(np.int64), full.view(np.int64), ids[0][doc], ids[1][doc], *((x - offsets[doc]).astype(np.int32) for x in (lows, highs))]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), lists, pa.array(again)], names=names)

    lists = found.groupBy(F.col("doc").alias("d"), F.col("rid").alias("r")).agg(F.collect_set(F.struct("gram", "lo", "hi", "at")).alias("s"))
    texts = rows.join(lists, (F.col("doc") == F.col("d")) & (F.col("rid") == F.col("r"))).select("doc", "rid", "text", *(F.col(f"s.{c}").alias(c) for c in ("gram", "lo", "hi", "at")))
    return texts.mapInArrow(run, "piece long, full long, doc long, rid long, lo int, hi int, windows array<long>, again boolean")


def repeated_spans(docs: DataFrame, length: int = 100) -> DataFrame:
    """(doc, rid, lo, hi): all window starts whose window also starts in a smaller document or earlier in the same text."""
    rows, span = _rows(docs), ["doc", "rid", "lo", "hi"]
    grams = materialize(_grams(rows, length), "grams")
    found = materialize(_stretches(rows, length).join(grams, "gram"), "stretches")
    discard(grams)
    fresh = found.where("not again").drop("again")
    # By gram: whether stretches differ; by stretch: its smallest document.
    first = materialize(fresh.groupBy("gram", "whole").agg(F.min("doc").alias("least")), "first")
    mixed = first.groupBy("gram").agg(F.min("whole").alias("x"), F.max("whole").alias("y")).select("gram", (F.col("x") != F.col("y")).alias("mixed"))
    placed = materialize(fresh.join(first.join(mixed, "gram"), ["gram", "whole"]).drop("whole"), "placed")
    spans = materialize(found.where("again").select(*span).union(placed.where("doc > least").select(*span)), "spans")
    discard(found, first)

    bins = materialize(_bins(rows, placed.where("doc = least and mixed"), length), "bins")
    discard(placed)
    new = bins.where("not again")
    full = materialize(new.groupBy("piece", "full").agg(F.min("doc").alias("least"), F.count("*").alias("n")), "full")
    pieces = full.groupBy("piece").agg(F.sum("n").alias("all"), (F.min("full") != F.max("full")).alias("mixed")).where("all > 1").drop("all")
    left = materialize(new.join(full.drop("n").join(pieces, "piece"), ["piece", "full"]), "left")
    # Windows that stand earlier in their text go whatever their bin: a bin that drops out here has none.
    listed = left.withColumn("windows", F.when(F.col("mixed") & (F.col("doc") == F.col("least")), F.col("windows")))
    windows = listed.where("windows is not null").select("piece", "doc", "rid", "lo", F.posexplode("windows").alias("at", "window"))
    windows = materialize(windows.select("piece", "window", "doc", "rid", (F.col("lo") + F.col("at")).alias("start")), "windows")
    known = windows.where("window is not null")
    least = known.groupBy("piece", "window").agg(F.min("doc").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = known.join(least, ["piece", "window"]).where("doc > least").union(windows.where("window is null").withColumn("least", F.lit(0).cast("long")))
    one = F.col("start").alias("lo"), F.col("start").alias("hi")
    more = bins.where("again").select(*span).union(left.where("doc > least").select(*span)).union(later.select("doc", "rid", *one))
    out = materialize(spans.union(more), "spans")
    discard(spans, bins, full, left, windows)
    return out


def remove_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the remaining bytes) of every row of doc_id, text.

    A byte goes if it lies in a string of `length` UTF-8 bytes that also starts earlier: in a
    smaller doc_id, or earlier in the same text. Overlaps count, strings never cross texts, and
    all are judged on the input. Null text: empty. Texts shorter than `length` stay as they
    are. A null doc_id comes before all others; rows with one doc_id do not precede each other.
    Other columns are not read.
    """
    spans = repeated_spans(docs, length)
    packed = (F.col("lo").cast("long") * (1 << 32)) + F.col("hi")
    lists = spans.groupBy(F.col("doc").alias("d"), F.col("rid").alias("r")).agg(F.collect_set(packed).alias("s"))
    rows = _rows(docs).join(lists, (F.col("doc") == F.col("d")) & (F.col("rid") == F.col("r")), "left")
    rows = rows.select(F.when(F.col("doc") != FIRST, F.col("doc")).alias("doc_id"), "text", "s")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offsets in by_block(b.column(1)):
                ranges = b.column(2).slice(i, j - i)
                per = np.array([0 if x is None else x for x in ranges.value_lengths().to_pylist()], np.int64)
                x, base = np.asarray(ranges.flatten()), np.repeat(offsets[:-1], per)
                edge = np.zeros(len(data) + 1, np.int32)
                np.add.at(edge, base + (x >> 32), 1)
                np.add.at(edge, base + (x & 0xFFFFFFFF) + length, -1)
                gone = np.cumsum(edge[:-1]) > 0
                begins = gone.copy()
                begins[1:] &= ~gone[:-1]
                inner = offsets[:-1][np.diff(offsets) > 0]
                begins[inner] = gone[inner]
                removed, runs = (np.diff(np.concatenate([[0], np.cumsum(m)])[offsets]) for m in (gone, begins))
                kept = np.concatenate([[0], np.cumsum(np.diff(offsets) - removed)]).astype(np.int32)
                bytes_ = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(kept), pa.py_buffer(np.ascontiguousarray(data[~gone]))])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), *(pa.array(c.astype(np.int64)) for c in (np.diff(offsets), removed, runs)), bytes_], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
                )

    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
