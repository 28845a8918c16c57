"""Exact Jaccard join of word shingle sets, size-aware: light sets by fixed-size subsets, heavy ones by inverted lists.

Shingles have one global order, rare ones first, by a table of counts of CELLS cells over all
texts; the order decides the cost only. Of two linked sets the first common shingle lies among
the first p of each, with p = n - ceil(t * n) + 1 for n shingles and similarity t, and the second
common one among the first p + 1.

- Light sets list all subsets of two of their first p + 1 shingles; linked light sets share one.
- Heavy sets, and those light ones that are large enough to be linked with a heavy one, stand in
  the inverted lists of their first p shingles. Lists without a heavy set are left aside.

Keys also name a class of sizes, so that sets of far sizes share no bucket. The boundary is the size at which rows and expected list scans together cost least, from
statistics over all sets. A subset and a list are both a bucket, decided as in `neardup`: around
hubs, then in blocks. What rules a pair out there is exact: sizes, and bitmaps of parities, which
differ in no more bits than the sets in shingles. Nothing that is linked gets lost.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import textkit as tk
from tessera.llm.linear import by_block
from tessera.llm.neardup import BLOCK, Registers, _keyed, _set_ids, _Side, classes_of, linked_labels, shingle_sets, with_components
from tessera.session import discard, materialize

U64 = tk.U64
#: Cells of the count table (a power of two), bits of the screen of shared keys (as many), and the bytes of one of the slices they are put together in.
CELL_BITS, SCREEN_BITS, SLICE = 24, 26, 1 << 16
CELLS = 1 << CELL_BITS
#: Sizes from which on sets are of another class: sets of far sizes share no bucket.
CLASSES = np.unique(np.floor(1.5 ** np.arange(1, 60)).astype(np.int64))
#: Steps of a doubling in which counts are told apart.
STEPS = 64
#: Sets whose bitmaps are compared in the time that a row takes.
COMPARED = 64
#: Largest size that the boundary is sought up to; subsets of two grow with the square of the size.
MOST_LIGHT = 400
_SUBSET, _LISTED = U64(0x9FB21C651E98DF25), U64(0xA24BAED4963EE407)


def prefix_length(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """p of sets of n shingles."""
    return n - -(-n * num // den) + 1


def put_together(parts: DataFrame, width: int, together: Callable[[np.ndarray, np.ndarray], np.ndarray], kind: type) -> np.ndarray:
    """One array of `width` entries from arrays that tasks made (slice, part: the bytes of SLICE entries of 8 bits, deflated), slice by slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for i, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                part = np.frombuffer(zlib.decompress(c), np.uint8).astype(kind)
                held[i] = together(held[i], part) if i in held else part
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([zlib.compress(h.tobytes(), 1) for h in held.values()], pa.binary())], names=["slice", "part"])

    out = np.zeros((width // SLICE, SLICE), kind)
    for r in parts.repartition("slice").mapInArrow(run, "slice long, part binary").toLocalIterator():  # `width` entries at any size of the input
        out[r["slice"]] = np.frombuffer(zlib.decompress(r.part), kind)
    return out.ravel()


def slices(entries: np.ndarray) -> pa.RecordBatch:
    """The slices of an array of 8-bit entries that hold any."""
    rows = entries.reshape(-1, SLICE)
    some = np.flatnonzero(rows.any(axis=1))
    return pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([zlib.compress(rows[i].tobytes(), 1) for i in some], pa.binary())], names=["slice", "part"])


def shingle_levels(docs: DataFrame, k: int) -> tuple[np.ndarray, float]:
    """For each cell the number of sets that hold a shingle of it, as steps of a logarithm; and the mean number.

    A task adds up its own cells, up to 255 each, and sends one byte a cell at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CELLS, np.uint32)
        for b in batches:
            for _, _, data, offsets in by_block(b.column(0)):
                np.add.at(counts, (shingle_sets(data, offsets, k)[0] >> U64(64 - CELL_BITS)).astype(np.int64), 1)
        yield slices(np.minimum(counts, 255).astype(np.uint8))

    counts = put_together(docs.select("text").mapInArrow(run, "slice long, part binary"), CELLS, np.add, np.uint32)
    return (np.log2(counts + 1.0) * STEPS).astype(np.uint16), float(counts.mean(dtype=np.float64))


def key_screen(keys: DataFrame) -> np.ndarray:
    """Packed bits of which each key sets one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << SCREEN_BITS, bool)
        for b in batches:
            bits[(b.column(0).to_numpy().view(U64) >> U64(64 - SCREEN_BITS)).astype(np.int64)] = True
        yield slices(np.packbits(bits, bitorder="little"))

    return put_together(keys.select("key").mapInArrow(run, "slice long, part binary"), 1 << (SCREEN_BITS - 3), np.bitwise_or, np.uint8)


def on_screen(screen: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = (keys >> U64(64 - SCREEN_BITS)).astype(np.int64)
    return (screen[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def size_class(n: np.ndarray) -> np.ndarray:
    return np.searchsorted(CLASSES, n, side="right")


def parity_bits(n: np.ndarray) -> np.ndarray:
    """Bits of a set's bitmap: a power of two from half its size on."""
    return np.maximum(64, 1 << np.ceil(np.log2(np.maximum(n, 1) / 2)).clip(0).astype(np.int64))


def parities(h: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """Bitmaps of sets: a bit is set if an odd number of shingles falls on it."""
    n = np.diff(bounds)
    width = parity_bits(n)
    base = np.concatenate([[0], np.cumsum(width)])
    at = np.repeat(base[:-1], n) + (h & (np.repeat(width, n) - 1).astype(U64)).astype(np.int64)
    raw = np.packbits((np.bincount(at, minlength=base[-1]) & 1).astype(np.uint8), bitorder="little").tobytes()
    return [raw[a:b] for a, b in zip((base // 8)[:-1].tolist(), (base // 8)[1:].tolist(), strict=True)]


def fold(bits: np.ndarray) -> np.ndarray:
    """Rows of bitmaps at half their width: parities of pairs of bits."""
    half = bits.shape[-1] // 2
    return bits[..., :half] ^ bits[..., half:]


def bit_distance(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Bits that differ, row by row; 0 where widths differ by more than one fold."""
    out = np.zeros(len(a), np.int64)
    x, y = a.to_pylist(), b.to_pylist()
    wide = np.array([[len(p), len(q)] for p, q in zip(x, y, strict=True)], np.int64).reshape(-1, 2)
    for p, q in np.unique(wide, axis=0):
        if max(p, q) > 2 * min(p, q):
            continue
        at = np.flatnonzero((wide[:, 0] == p) & (wide[:, 1] == q))
        m = [np.frombuffer(b"".join(s[i] for i in at), U64).reshape(len(at), -1) for s in (x, y)]
        m = [fold(s) if s.shape[1] * 8 > min(p, q) else s for s in m]
        out[at] = np.bitwise_count(m[0] ^ m[1]).sum(axis=1)
    return out


def subset_keys(one: np.ndarray, two: np.ndarray, sized: np.ndarray | int) -> np.ndarray:
    return tk.mix64(tk.mix64(one * _SUBSET + np.asarray(sized, U64)) + two)


def list_keys(one: np.ndarray, sized: np.ndarray | int) -> np.ndarray:
    return tk.mix64(tk.mix64(one ^ _LISTED) + np.asarray(sized, U64))


class Parities(Registers):
    """Pairs of sets by sizes and bitmaps; a bucket decides those of which it is the first common one."""

    listed = ("prefix",)
    worth = 64

    def __init__(self, num: int, den: int, boundary: int) -> None:
        super().__init__(num, den)
        self.boundary = boundary

    def too_far(self, bits: np.ndarray, n: np.ndarray) -> np.ndarray:
        """n: sizes of both sets together. Linked sets differ in n * (den - num) / (den + num) shingles at most."""
        return bits * (self.den + self.num) > n * (self.den - self.num)

    def hopeless(self, a: pa.Array, b: pa.Array, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
        return self.too_far(bit_distance(a, b), n_a + n_b)

    def load(self, marks: pa.Array) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
        """Widths in words; and by width the place of each member and the bitmaps of those of this width or folded to it."""
        raw = [np.frombuffer(m.as_buffer(), U64) for m in marks]
        width = np.array([len(r) for r in raw])
        held = {}
        for w in np.unique(np.concatenate([width, np.maximum(width // 2, 1)])):
            at = np.flatnonzero((width == w) | (width == 2 * w))
            place = np.full(len(raw), -1)
            place[at] = np.arange(len(at))
            held[int(w)] = place, np.array([fold(raw[i]) if len(raw[i]) > w else raw[i] for i in at], U64).reshape(len(at), int(w))
        return width, held

    def due(self, x: _Side, i: int, y: _Side, at: np.ndarray, key: int) -> np.ndarray:
        (mine, own), (theirs, held) = x.marks, y.marks
        common, left = np.minimum(theirs[at], mine[i]), np.zeros(len(at), bool)
        for w in np.unique(common):
            some = np.flatnonzero(common == w)
            place, bits = held[int(w)]
            mark = own[int(w)][1][own[int(w)][0][i]] if int(w) in own and own[int(w)][0][i] >= 0 else None
            # Sizes that fit differ by one fold at most.
            apart = np.bitwise_count(bits[place[at[some]]] ^ mark).sum(axis=1) if mark is not None and (place[at[some]] >= 0).all() else 0
            left[some] = ~self.too_far(np.zeros(len(some), np.int64) + apart, y.n[at[some]] + x.n[i])
        return at[left]

    def here(self, x: _Side, i: int, y: _Side, at: np.ndarray, key: int) -> np.ndarray:
        own = np.frombuffer(x.listed[0][i].as_buffer(), U64)
        order = np.argsort(own)
        lists = [np.frombuffer(y.listed[0][int(j)].as_buffer(), U64) for j in at]
        size = np.array([len(s) for s in lists])
        flat, start = np.concatenate(lists), np.concatenate([[0], np.cumsum(size)[:-1]])
        found = np.searchsorted(own[order], flat).clip(0, len(own) - 1)
        rank = np.where(own[order][found] == flat, order[found], len(own))
        light = (y.n[at] <= self.boundary) & (x.n[i] <= self.boundary)
        # In lists, only the first p shingles of either set count.
        short = prefix_length(y.n[at], self.num, self.den)
        inside = (np.arange(len(flat)) - np.repeat(start, size) < np.repeat(short, size)) & (rank < prefix_length(x.n[i], self.num, self.den))
        rank = np.where(np.repeat(light, size) | inside, rank, len(own))
        one = np.minimum.reduceat(rank, start)
        two = np.minimum.reduceat(np.where(rank == np.repeat(one, size), len(own), rank), start)
        known = np.append(own, U64(0))
        sized = size_class(np.minimum(y.n[at], x.n[i]))
        keys = np.where(light, subset_keys(known[one], known[two], sized), list_keys(known[one], sized)).view(np.int64)
        return at[(keys == key) & (np.where(light, two, one) < len(own))]


def _features(docs: DataFrame, k: int, num: int, den: int, levels: np.ndarray, mean: float) -> DataFrame:
    """doc_id, th, n, cid, regs (the bitmap), prefix (the first p + 1 shingles) and scan (how many others the first p lists may hold, up to a block each) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)
    names = ["doc_id", "th", "n", "cid", "regs", "prefix", "scan"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for b in batches:
            for i, j, data, offsets in by_block(b.column(2)):
                h, d, bounds = shingle_sets(data, offsets, k)
                n = np.diff(bounds)
                level = table[(h >> U64(64 - CELL_BITS)).astype(np.int64)]
                # Stable: shingles of one level stay in the order of their hashes.
                order = np.argsort((d.astype(np.int64) << 16) | level, kind="stable")
                p = prefix_length(n, num, den)
                place = np.arange(len(h)) - np.repeat(bounds[:-1], n)
                first = order[place <= np.repeat(p, n)]
                size = np.minimum(p + 1, n)
                ends = np.concatenate([[0], np.cumsum(size)])
                raw = h[first].tobytes()
                # What stands out of the other shingles of a cell.
                others = np.clip(np.exp2(level[order] / STEPS) - 2 - mean - 3 * math.sqrt(mean), 0, BLOCK)
                scan = np.concatenate([[0], np.cumsum(np.where(place < np.repeat(p, n), others, 0))])[bounds]
                columns = [b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(n, pa.int64()), pa.array(_set_ids(h, bounds), pa.binary()), pa.array(parities(h, bounds), pa.binary())]
                prefix = pa.array([raw[8 * a : 8 * e] for a, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*columns, prefix, pa.array(np.diff(scan).astype(np.int64))], names=names)

    return _keyed(docs).mapInArrow(run, "doc_id long, th long, n long, cid binary, regs binary, prefix binary, scan long")


def boundary_of(classes: DataFrame, num: int, den: int) -> int:
    """The largest size of a light set: where the rows of light sets, and the rows and comparisons of heavy ones, cost least in all."""
    sizes = classes.groupBy(F.least("n", F.lit(MOST_LIGHT + 1)).alias("n")).agg(F.count("*").alias("rows"), F.sum("scan").alias("scan")).collect()  # MOST_LIGHT + 1 rows at most
    light, heavy = np.zeros(MOST_LIGHT + 2), np.zeros(MOST_LIGHT + 2)
    for r in sizes:
        p = int(prefix_length(np.int64(r.n), num, den))
        light[r.n], heavy[r.n] = r.rows * math.comb(min(p + 1, r.n), 2), r.rows * p + r.scan / COMPARED
    light[-1] = np.inf
    cost = np.cumsum(light)[:-1] + heavy.sum() - np.cumsum(heavy)[:-1]
    return int(cost.argmin())


def _rows_of_buckets(classes: DataFrame, num: int, den: int, boundary: int, screen: np.ndarray | None = None) -> DataFrame:
    """(key, nid, n, subset): every subset and list that a set stands in, once for each class of sizes down to that of its smallest partner.

    With a screen, only those whose keys may be shared.
    """
    shared = classes.sparkSession.sparkContext.broadcast(screen) if screen is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nid, n = (b.column(c).to_numpy() for c in range(2))
            top, low = size_class(n), size_class(-(-n * num // den))
            keys, owner, subset, held = [], [], [], 0
            for i, p in enumerate(prefix_length(n, num, den).tolist()):
                own = np.frombuffer(b.column(2)[i].as_buffer(), U64)
                for sized in range(low[i], top[i] + 1):
                    if n[i] <= boundary:
                        one, two = np.triu_indices(len(own), 1)
                        keys.append(subset_keys(own[one], own[two], sized))
                        owner.append(np.full(len(one), i))
                        subset.append(np.ones(len(one), bool))
                    if n[i] * den >= num * (boundary + 1):
                        keys.append(list_keys(own[:p], sized))
                        owner.append(np.full(p, i))
                        subset.append(np.zeros(p, bool))
                held += p
                if held > 1 << 16 or i + 1 == len(n):
                    at = np.concatenate(owner) if owner else np.zeros(0, np.int64)
                    columns = [np.concatenate(keys) if keys else at.view(U64), nid[at], n[at], np.concatenate(subset) if subset else at.astype(bool)]
                    if shared is not None:
                        kept = on_screen(shared.value, columns[0])
                        columns = [c[kept] for c in columns]
                    yield pa.RecordBatch.from_arrays([pa.array(columns[0].view(np.int64)), *map(pa.array, columns[1:])], names=["key", "nid", "n", "subset"])
                    keys, owner, subset, held = [], [], [], 0

    # A set and a different one that it is linked with have more than num / (den - num) shingles together in common.
    able = classes.where(F.col("n") * (den - num) >= num)
    return able.select("nid", "n", "prefix").mapInArrow(run, "key long, nid long, n long, subset boolean")


def _members(classes: DataFrame, num: int, den: int, boundary: int) -> DataFrame:
    """(key, nid, n, hub, hub_n, m) of the sets of each bucket of two or more; of lists, only those that hold a heavy set.

    Few keys are shared. Their bits form a screen of a fixed size, behind which only the rows of shared keys are exchanged, until the screen is full.
    """
    found = _rows_of_buckets(classes, num, den, boundary).groupBy("key").agg(F.min(F.struct("nid", "n")).alias("hub"), F.count("*").alias("m"), F.max("n").alias("top"), F.first("subset").alias("subset"))
    shared = found.where((F.col("m") > 1) & (F.col("subset") | (F.col("top") > boundary))).select("key", "m", F.col("hub.nid").alias("hub"), F.col("hub.n").alias("hub_n"))
    shared = materialize(shared, "buckets")
    members = materialize(_rows_of_buckets(classes, num, den, boundary, key_screen(shared)).drop("subset").join(shared, "key"), "members")
    discard(shared)
    return members


def jaccard_join(docs: DataFrame, k: int = 3, num: int = 9, den: int = 10) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of doc_id, text.

    Rows are linked if den * intersection >= num * union of their sets of k-word shingles
    (words: runs between ASCII blanks, A-Z folded; fewer than k words: the whole sequence is
    the one shingle). component_id is the smallest doc_id that links reach, itself included.
    Null, empty and blank texts have no shingles and link with nothing. Repeated rows and equal
    sets are one set and each row is returned. A null doc_id takes part in links but names no
    component, unless its component has no other: then component_id is null. Other columns are
    not read. Sets are of 64-bit hashes: a link is false only if shingles of its two sets share
    one, at a chance of about |A| * |B| / 2 ** 64; none is missed.
    """
    levels, mean = shingle_levels(docs, k)
    rows = materialize(_features(docs, k, num, den, levels, mean), "features")
    classes = classes_of(rows, "regs", "prefix", "scan")
    boundary = boundary_of(classes, num, den)
    labels = linked_labels(docs, classes, _members(classes, num, den, boundary), k, Parities(num, den, boundary))
    return with_components(rows, classes, labels).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
