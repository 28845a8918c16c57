"""Near-duplicate documents by HyperMinHash sketches, banding and exact verification.

A text's distinct word shingles fall into 128 buckets by their leading hash bits; each
bucket stores the leading-zero count and ten mantissa bits of its smallest hash in 16
bits. Bands of four registers propose links, a collision-corrected Jaccard estimate
drops hopeless ones, and the full sets decide the rest.

Texts with equal sets form a class, and links are sought between classes. Within a band
bucket every class is held against one hub; found links contract the classes to
components, and buckets that then still hold several components get another hub from
outside their largest one, as long as that finds many links. So a bucket of m members
yields at most m links a round. What is open then is decided whole: blocks of the members
outside the largest component meet blocks of all members, first with their sketches alone,
then, where a pair is left to decide, with their texts. Each pair of different components
is decided once on its full sets, and a task lists only links that join two components it
has not yet joined. No group is ever gathered in one task, and a block's size is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import textkit as tk
from tessera.llm.components import components, contract
from tessera.llm.linear import by_block
from tessera.session import discard, materialize

U64 = tk.U64
REGISTERS, BAND = 128, 4
BANDS = REGISTERS // BAND
MANTISSA = 10
#: Open buckets get another hub while one in so many of the last round's pairs is a link, in so many rounds at most.
USEFUL, ROUNDS = 8, 8
#: What is held together when open buckets are decided whole: members, and their shingles.
BLOCK, BLOCK_SHINGLES = 128, 1 << 18
#: For each register the order in which others are asked to stand in for an empty one.
_STAND_IN = np.argsort(tk.mix64(np.arange(REGISTERS * REGISTERS, dtype=U64)).reshape(REGISTERS, REGISTERS), axis=1)


def sketch(h: np.ndarray, d: np.ndarray, n_docs: int) -> np.ndarray:
    """(documents, 128) registers of sorted distinct hashes: (leading zeros + 1) and mantissa; 0 where empty."""
    regs = np.zeros((n_docs, REGISTERS), np.uint16)
    if not len(h):
        return regs
    bucket = (h >> U64(57)).astype(np.int64)
    head = np.ones(len(h), bool)
    head[1:] = (bucket[1:] != bucket[:-1]) | (d[1:] != d[:-1])
    low = (h[head] << U64(7)) | U64(1 << 6)
    zeros = 64 - np.frexp((low >> U64(11)).astype(np.float64) + 0.5)[1] - 11
    zeros = np.minimum(zeros, 52).astype(U64)
    mantissa = (low << (zeros + U64(1))) >> U64(64 - MANTISSA)
    regs[d[head], bucket[head]] = (((zeros + U64(1)) << U64(MANTISSA)) | mantissa).astype(np.uint16)
    return regs


def densify(regs: np.ndarray) -> np.ndarray:
    """Empty registers take the value of the first filled one of a fixed random order."""
    out, empty = regs.copy(), regs == 0
    for t in range(REGISTERS):
        if not empty.any():
            break
        source = regs[:, _STAND_IN[:, t]]
        take = empty & (source > 0)
        out[take] = source[take]
        empty &= ~take
        if t == 0:
            empty[(regs == 0).all(axis=1)] = False
    return out


def band_keys(regs: np.ndarray) -> np.ndarray:
    """(documents, 32) keys: four registers of 16 bits are one 64-bit word."""
    words = np.ascontiguousarray(densify(regs)).view(U64)
    return tk.mix64(words + np.arange(1, BANDS + 1, dtype=U64) * U64(0xA24BAED4963EE407)).view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimates from registers, less the matches expected of unequal hashes; and the number of registers used."""
    used = ((a > 0) | (b > 0)).sum(axis=1)
    same = ((a == b) & (a > 0)).sum(axis=1)
    # Two independent minima agree in zeros with chance about 1/3 and in the mantissa with 2 ** -10.
    chance = 1 / 3 / 2**MANTISSA
    return (same / np.maximum(used, 1) - chance) / (1 - chance), used


def hopeless(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Pairs whose estimate is seven standard deviations of a true similarity `least` below it; never if few registers are used."""
    j, used = estimate(a, b)
    return (used >= 96) & (j < least - 7 * np.sqrt(least * (1 - least) / np.maximum(used, 1)))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(offsets) - 1
    h, d = tk.word_hashes(data, offsets, tk.NOT_BLANK)
    return tk.sorted_sets(*tk.shingle_hashes(h, d, n, k), n)


def _set_ids(h: np.ndarray, bounds: np.ndarray) -> list[bytes | None]:
    """128 bits that stand for a whole sorted set; None for an empty one."""
    import hashlib

    return [hashlib.blake2b(h[a:b].tobytes(), digest_size=16).digest() if b > a else None for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")


def _features(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, th (the text's hash), n, cid (None for an empty set) and regs of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offsets in by_block(b.column(2)):
                h, d, bounds = shingle_sets(data, offsets, k)
                regs = sketch(h, d, j - i)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(np.diff(bounds), pa.int64()), pa.array(_set_ids(h, bounds), pa.binary()), pa.array([r.tobytes() for r in regs], pa.binary())],
                    names=["doc_id", "th", "n", "cid", "regs"],
                )

    return _keyed(docs).mapInArrow(run, "doc_id long, th long, n long, cid binary, regs binary")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def _bands(classes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = band_keys(_matrix(b.column(1)))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), BANDS)), pa.array(keys.ravel())], names=["nid", "key"])

    return classes.select("nid", "regs").mapInArrow(run, "nid long, key long")


class Registers:
    """What the stages on pairs know of a class beside its size: its sketch, which also tells the bands.

    Another candidate search brings its own: `listed` names columns of the classes that are read
    only where texts are compared. `worth` ends the rounds of hubs where there are more open members
    for a link of the last one, as each round has a price of its own and blocks decide the rest as well.
    """

    listed: tuple[str, ...] = ()
    worth = float("inf")

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den = num, den

    def hopeless(self, a: pa.Array, b: pa.Array, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
        return hopeless(_matrix(a), _matrix(b), self.num / self.den)

    def load(self, marks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        regs = _matrix(marks)
        return regs, band_keys(regs)

    def due(self, x: "_Side", i: int, y: "_Side", at: np.ndarray, key: int) -> np.ndarray:
        """Of the other block's members `at` those that may be linked with member i, each in the bucket of their first common band."""
        (regs, keys), (others, theirs) = x.marks, y.marks
        same = theirs[at] == keys[i]
        first = same.argmax(axis=1)
        at = at[same.any(axis=1) & (keys[i][first] == key)]
        return at[~hopeless(regs[i : i + 1], others[at], self.num / self.den)] if len(at) else at

    def here(self, x: "_Side", i: int, y: "_Side", at: np.ndarray, key: int) -> np.ndarray:
        """Of these, the ones that this bucket decides."""
        return at


def _likely(pairs: DataFrame, classes: DataFrame, screen: Registers) -> DataFrame:
    """Pairs (a, b) that the set sizes and the sketches leave possible."""
    num, den = screen.num, screen.den
    side = lambda x: classes.select(F.col("nid").alias(x), F.col("n").alias(f"n_{x}"), F.col("regs").alias(f"r_{x}"))
    rows = pairs.join(side("b"), "b").join(side("a"), "a").where(F.least("n_a", "n_b") * den >= F.greatest("n_a", "n_b") * num).select("a", "b", "r_a", "r_b", "n_a", "n_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                keep = pa.array(~screen.hopeless(b.column(2), b.column(3), b.column(4).to_numpy(), b.column(5).to_numpy()))
                yield b.select(["a", "b"]).filter(keep)

    return rows.mapInArrow(run, "a long, b long")


def _texts(docs: DataFrame, classes: DataFrame, nids: DataFrame) -> DataFrame:
    """(nid, text): one text of every class asked for."""
    want = classes.join(nids, "nid", "left_semi").select("nid", F.col("at.doc_id").alias("__doc"), F.col("at.th").alias("__th"))
    met = (F.col("th") == F.col("__th")) & F.col("doc_id").eqNullSafe(F.col("__doc"))
    out = materialize(_keyed(docs).join(want, met).select("nid", "text"), "texts")
    if out.count() == nids.count():
        return out
    # Rows that repeat doc_id and text: one of each stays.
    one = materialize(out.dropDuplicates(["nid"]), "texts")
    discard(out)
    return one


def _links(pairs: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs whose full sets meet the threshold."""
    side = lambda x: texts.select(F.col("nid").alias(x), F.col("text").alias(f"t_{x}"))
    rows = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "t_a", "t_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        @lru_cache(8)
        def full(text: str) -> np.ndarray:
            raw = np.frombuffer(text.encode(), np.uint8)
            return shingle_sets(raw, np.array([0, len(raw)]), k)[0]

        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                s, t = full(x.as_py()), full(y.as_py())
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(den * both >= num * (len(s) + len(t) - both))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(run, "a long, b long")


def _confirmed(pairs: DataFrame, docs: DataFrame, classes: DataFrame, k: int, screen: Registers) -> tuple[DataFrame, int]:
    """The links among proposed pairs, written; and their number, or 0 if they are too few of the pairs for another round of hubs."""
    likely = materialize(_likely(pairs, classes, screen), "pairs")
    nids = materialize(likely.select(F.explode(F.array("a", "b")).alias("nid")).distinct(), "nids")
    texts = _texts(docs, classes, nids)
    links = materialize(_links(likely, texts, k, screen.num, screen.den), "links")
    found = links.count()
    useful = found * USEFUL >= likely.count()
    discard(likely, nids, texts)
    return links, found if useful else 0


def _open(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, nid, n, label, main): the members of buckets that hold several components, and the label of each bucket's largest one."""
    sizes = labels.groupBy("label").agg(F.count("*").alias("size"))
    known = labels.join(sizes, "label").select(F.col("node").alias("nid"), "label", "size")
    rows = members.select("key", "nid", "n").join(known, "nid", "left").select("key", "nid", "n", F.coalesce("label", "nid").alias("label"), F.coalesce("size", F.lit(1)).alias("size"))
    keys = rows.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.max_by("label", F.struct("size", "label")).alias("main")).where("lo < hi")
    return rows.drop("size").join(keys.select("key", "main"), "key")


def _around_hubs(opened: DataFrame, turn: int) -> DataFrame:
    """(a, b): in each open bucket one member outside the largest component, another in each turn, and all members of other components."""
    hub = opened.where("label <> main").groupBy("key").agg(F.min_by(F.struct("nid", "label"), F.xxhash64("nid", F.lit(turn))).alias("hub"))
    met = opened.join(hub, "key").where(F.col("label") != F.col("hub.label"))
    return met.select(F.least("nid", "hub.nid").alias("a"), F.greatest("nid", "hub.nid").alias("b")).distinct()


def _blocks(opened: DataFrame, classes: DataFrame, listed: tuple[str, ...] = (), texts: DataFrame | None = None) -> DataFrame:
    """Members of open buckets in blocks (key, part, minor, parts, and lists of nid, label, n, regs and, if given, more columns and text)."""
    columns = ["nid", "label", "n", "regs", *listed, *(["text"] if texts is not None else [])]
    parts = opened.groupBy("key").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("parts"))
    full = opened.join(parts, "key").join(classes.select("nid", "regs", *listed), "nid")
    full = full if texts is None else full.join(texts, "nid")
    full = full.withColumn("part", F.pmod(F.xxhash64("nid"), F.col("parts"))).withColumn("minor", F.col("label") != F.col("main"))
    return full.groupBy("key", "part", "minor").agg(F.first("parts").alias("parts"), *(F.collect_list(c).alias(c) for c in columns))


def _block_pairs(blocks: DataFrame) -> DataFrame:
    """Each block of members outside a bucket's largest component (columns a_*) beside each block of the bucket, dealt out by the latter."""
    columns = [c for c in blocks.columns if c not in ("key", "part", "minor", "parts")]
    a = blocks.where("minor").select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), *(F.col(c).alias(f"a_{c}") for c in columns))
    return a.join(blocks.select("key", "part", *columns), ["key", "part"])


@dataclass
class _Side:
    """One block of a pair of blocks."""

    nid: np.ndarray
    label: np.ndarray
    n: np.ndarray
    marks: object
    listed: list[pa.Array]
    text: pa.Array | None

    @classmethod
    def of(cls, b: pa.RecordBatch, r: int, mark: str, screen: Registers) -> _Side:
        get = lambda c: b.column(b.schema.get_field_index(mark + c))[r].values
        has = [c for c in screen.listed if mark + c in b.schema.names]
        return cls(*(np.asarray(get(c)) for c in ("nid", "label", "n")), screen.load(get("regs")), [get(c) for c in has], get("text") if mark + "text" in b.schema.names else None)

    def due(self, i: int, other: _Side, key: int, screen: Registers) -> np.ndarray:
        """The other block's members of other components that may be linked with member i."""
        sized = np.minimum(other.n, self.n[i]) * screen.den >= np.maximum(other.n, self.n[i]) * screen.num
        at = np.flatnonzero(sized & (other.label != self.label[i]))
        return screen.due(self, i, other, at, key) if len(at) else at


class _Forest:
    """Components of labels that a task has joined so far."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def _asked(pairs: DataFrame, screen: Registers) -> DataFrame:
    """(key, nid) of the members that have any partner to be decided in that bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for b in batches:
            new: set[tuple[int, int]] = set()
            for r in range(b.num_rows):
                key, x, y = b.column(0)[r].as_py(), _Side.of(b, r, "a_", screen), _Side.of(b, r, "", screen)
                for i in range(len(x.nid)):
                    if len(at := x.due(i, y, key, screen)):
                        new.update((key, n) for n in (int(x.nid[i]), *y.nid[at].tolist()))
            new -= seen
            seen |= new
            got = np.array(sorted(new), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], names=["key", "nid"])

    return pairs.mapInArrow(run, "key long, nid long").distinct()


def _block_links(pairs: DataFrame, k: int, screen: Registers) -> DataFrame:
    """(a, b): links between the components of members that share a bucket, as labels; a task lists no link that its others imply."""
    num, den = screen.num, screen.den

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[int, np.ndarray] = {}
        held = 0
        forest = _Forest()

        def full_set(side: _Side, i: int) -> np.ndarray:
            nonlocal held
            nid = int(side.nid[i])
            if nid not in cache:
                if held > 4 * BLOCK_SHINGLES:
                    cache.clear()
                    held = 0
                raw = np.frombuffer(side.text[i].as_buffer(), np.uint8)
                cache[nid] = shingle_sets(raw, np.array([0, len(raw)]), k)[0]
                held += len(cache[nid])
            return cache[nid]

        for b in batches:
            found: list[tuple[int, int]] = []
            for r in range(b.num_rows):
                key, x, y = b.column(0)[r].as_py(), _Side.of(b, r, "a_", screen), _Side.of(b, r, "", screen)
                for i in range(len(x.nid)):
                    mine = int(x.label[i])
                    at = np.array([j for j in x.due(i, y, key, screen) if forest.root(int(y.label[j])) != forest.root(mine)], np.int64)
                    at = screen.here(x, i, y, at, key) if len(at) else at
                    if not len(at):
                        continue
                    own, sets = full_set(x, i), [full_set(y, int(j)) for j in at]
                    every, owner = np.concatenate(sets), np.repeat(np.arange(len(at)), y.n[at])
                    both = np.bincount(owner, weights=own[np.searchsorted(own, every).clip(0, len(own) - 1)] == every, minlength=len(at)).astype(np.int64)
                    linked = at[den * both >= num * (y.n[at] + x.n[i] - both)]
                    found += [(mine, int(y.label[j])) for j in linked if forest.join(mine, int(y.label[j]))]
            got = np.array(found, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], names=["a", "b"])

    return pairs.mapInArrow(run, "a long, b long").distinct()


def _decided(opened: DataFrame, docs: DataFrame, classes: DataFrame, k: int, screen: Registers) -> DataFrame:
    """The links of all that is still open, as labels, written. Sketches tell first which members need their texts in which bucket."""
    blocks = materialize(_blocks(opened, classes), "blocks")
    asked = materialize(_asked(_block_pairs(blocks), screen), "asked")
    discard(blocks)
    nids = materialize(asked.select("nid").distinct(), "nids")
    texts = _texts(docs, classes, nids)
    blocks = materialize(_blocks(opened.join(asked, ["key", "nid"], "left_semi"), classes, screen.listed, texts), "blocks")
    discard(asked, nids, texts)
    links = materialize(_block_links(_block_pairs(blocks), k, screen), "links")
    discard(blocks)
    return links


def _members(classes: DataFrame) -> DataFrame:
    """(key, nid, n, hub, m) of the classes of each band bucket of two or more, written."""
    buckets = _bands(classes).groupBy("key").agg(F.min("nid").alias("hub"), F.count("*").alias("m")).where("m > 1").select("key", "hub", "m")
    shared = materialize(buckets, "buckets")
    members = materialize(_bands(classes).join(shared, "key").join(classes.select("nid", "n"), "nid"), "members")
    discard(shared)
    return members


def linked_labels(docs: DataFrame, classes: DataFrame, members: DataFrame, k: int, screen: Registers) -> DataFrame:
    """(node, label) of every class that has a link with another that it shares a bucket of `members` with."""
    apart = F.least("n", "hub_n") * screen.den < F.greatest("n", "hub_n") * screen.num if "hub_n" in members.columns else F.lit(False)
    pairs = members.where((F.col("nid") != F.col("hub")) & ~apart).select(F.least("hub", "nid").alias("a"), F.greatest("hub", "nid").alias("b")).distinct()
    links, useful = _confirmed(pairs, docs, classes, k, screen)
    whole = members
    # The one pair of a bucket of two is decided.
    members = members.where("m > 2")
    labels, turn = components(links), 0
    while True:
        opened = materialize(_open(members, labels), "opened")
        discard(whole, links)
        members, whole, turn = opened, opened, turn + 1
        if not (left := opened.count()):
            break
        if last := not useful or useful * screen.worth < left or turn > ROUNDS:
            links = _decided(opened, docs, classes, k, screen)
        else:
            pairs, useful = _confirmed(_around_hubs(opened, turn), docs, classes, k, screen)
            place = opened.select("nid", "label").distinct()
            named = pairs.join(place.select(F.col("nid").alias("a"), F.col("label").alias("la")), "a").join(place.select(F.col("nid").alias("b"), F.col("label").alias("lb")), "b")
            links = materialize(named.select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct(), "links")
            discard(pairs)
        if links.limit(1).count():
            labels = contract(labels, links)
        if last:
            break
    discard(whole, links)
    return labels


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5, text_hash: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, kept and, if asked, text_hash (xxhash64) of every row of doc_id, text.

    Rows are linked if den * intersection >= num * union of their sets of k-word shingles
    (words: runs between ASCII blanks, A-Z folded; fewer than k words: the whole sequence is
    the one shingle). component_id is the smallest doc_id that links reach; kept says whether
    it is the row's own. Null, empty and blank texts have no shingles and link with nothing.
    Repeated rows form one class and each is returned. A null doc_id takes part in links but
    names no component, unless its component has no other: then component_id is null and kept
    true. Other columns are not read. Sets are of 64-bit hashes: a link is false only if shingles of its
    two sets share one, at a chance of about |A| * |B| / 2 ** 64. A pair at the threshold shares no band with a chance of
    about 1e-10 (three words, 0.85) and is then missed, unless other links join it.
    """
    rows = materialize(_features(docs, k), "features")
    classes = classes_of(rows, "regs")
    out = with_components(rows, classes, linked_labels(docs, classes, _members(classes), k, Registers(num, den)))
    hashes = [F.col("th").alias("text_hash")] if text_hash else []
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), *hashes)


def classes_of(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows of equal sets (cid) as one: nid, cid, doc (its smallest doc_id), at (a row that has the text), n and the named columns, written."""
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "th")
    found = rows.where("cid is not null").groupBy("cid").agg(F.min("doc_id").alias("doc"), F.min(place).alias("at"), F.first("n").alias("n"), *(F.first(c).alias(c) for c in columns))
    return materialize(found.withColumn("nid", F.monotonically_increasing_id()), "classes")


def with_components(rows: DataFrame, classes: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, th, n, cid and component_id (the smallest doc_id of the component) of every row."""
    named = classes.join(labels, classes.nid == labels.node, "left").select("cid", "doc", F.coalesce("label", "nid").alias("label"))
    first = materialize(named.groupBy("label").agg(F.min("doc").alias("component_id")), "first")
    ids = materialize(named.join(first, "label").select("cid", F.lit(True).alias("found"), "component_id"), "ids")
    discard(classes, labels, first)
    out = rows.select("doc_id", "th", "n", "cid").join(ids, "cid", "left")
    return out.withColumn("component_id", F.when(F.col("found"), F.col("component_id")).otherwise(F.col("doc_id")))
