"""Centroid clustering (Lloyd rounds) of integer vectors by kd-tree filtering.

Vectors are stored once in kd-trees of some thousand vectors, a table of one row a tree whose
nodes hold counts, integer sums and bounding boxes. A round sends the centroids down every
tree: of those still open at a node, the one nearest to the middle of its box stays, and a
centroid goes if even the corner of the box that lies farthest in its direction is strictly
nearer to that one. A node with one centroid left is assigned whole, by its count and sum;
vectors of leaves with several are resolved one by one. All arithmetic is in integers.

A task adds up its trees, so a round exchanges one row a task and centroid.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import discard, materialize

#: Vectors of a leaf at most.
LEAF = 16
#: Largest component in amount: squared distances of up to 64 of them stay in a long.
MOST = 1 << 26
_FAR = np.iinfo(np.int64).max


def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b of integers, exactly: in doubles while all sums stay below 2 ** 53."""
    top = [int(np.abs(x).max(initial=0)) for x in (a, b)]
    if top[0] * top[1] * a.shape[-1] < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64)


class Tree:
    """A kd-tree over vectors in the order of its leaves: level l splits them into 2 ** l runs of near equal size."""

    def __init__(self, points: np.ndarray):
        """Puts the rows of `points` (owned by the tree) in order; `order` says where each came from."""
        n = len(points)
        self.order = np.arange(n)
        self.levels = 0
        while n >> self.levels > LEAF:
            cuts = self.cuts(n, self.levels)
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                part = points[a:b]
                wide = int((part.max(axis=0) - part.min(axis=0)).argmax())
                # The place where the next level cuts this run.
                at = np.argpartition(part[:, wide], (a + b) // 2 - a)
                points[a:b], self.order[a:b] = part[at], self.order[a:b][at]
            self.levels += 1
        self.points = points

    @staticmethod
    def cuts(n: int, level: int) -> np.ndarray:
        """Bounds of the runs of a level: each run of the level above is halved."""
        out = np.array([0, n])
        for _ in range(level):
            wider = np.empty(2 * len(out) - 1, np.int64)
            wider[::2], wider[1::2] = out, (out[:-1] + out[1:]) // 2
            out = wider
        return out

    def nodes(self) -> np.ndarray:
        """(nodes, 3, dimensions) of all levels from the root: least, largest and sum; a node's count is that of its run."""
        rows = []
        for level in range(self.levels + 1):
            at = self.cuts(len(self.points), level)[:-1]
            rows.append(np.stack([f.reduceat(self.points, at, axis=0) for f in (np.minimum, np.maximum, np.add)], axis=1))
        return np.concatenate(rows)


def descend(points: np.ndarray, nodes: np.ndarray, levels: int, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]], np.ndarray]:
    """Counts and sums by centroid; (from, to, centroid) of the nodes assigned whole; and of each vector of an open leaf its centroid, -1 elsewhere."""
    k, n = len(centres), len(points)
    counts, sums = np.zeros(k, np.int64), np.zeros((k, centres.shape[1]), np.int64)
    whole: list[tuple[int, int, int]] = []
    single = np.full(n, -1, np.int64)
    open_, left = np.zeros(1, np.int64), np.ones((1, k), bool)
    squares = (centres * centres).sum(axis=1)
    first = 0
    for level in range(levels + 1):
        cuts = Tree.cuts(n, level)
        box = nodes[first + open_]
        lo, hi = box[:, 0], box[:, 1]
        # Twice the distance to the middle of the box, less what all centroids share.
        middle = np.where(left, 2 * squares - 2 * dot(lo + hi, centres.T), _FAR).argmin(axis=1)
        for z in np.unique(middle):
            at = np.flatnonzero(middle == z)
            to = centres - centres[z]
            # |c - corner| ** 2 - |z - corner| ** 2 at the corner of the box that lies farthest towards c.
            apart = squares - squares[z] - 2 * (dot(hi[at], np.maximum(to, 0).T) + dot(lo[at], np.minimum(to, 0).T))
            left[at] &= apart <= 0
        alone = left.sum(axis=1) == 1
        only = left[alone].argmax(axis=1)
        a, b = cuts[open_[alone]], cuts[open_[alone] + 1]
        np.add.at(counts, only, b - a)
        np.add.at(sums, only, box[alone, 2])
        whole += zip(a.tolist(), b.tolist(), only.tolist(), strict=True)
        first += 1 << level
        if level < levels:
            open_ = (2 * open_[~alone][:, None] + np.arange(2)).ravel()
            left = np.repeat(left[~alone], 2, axis=0)
        else:
            a, b = cuts[open_[~alone]], cuts[open_[~alone] + 1]
            rows = np.repeat(a - np.concatenate([[0], np.cumsum(b - a)[:-1]]), b - a) + np.arange((b - a).sum()) if len(a) else np.zeros(0, np.int64)
            far = squares - 2 * dot(points[rows], centres.T)
            single[rows] = np.where(np.repeat(left[~alone], b - a, axis=0), far, _FAR).argmin(axis=1)
        if not len(open_):
            break
    rows = np.flatnonzero(single >= 0)
    mine = (single[rows] == np.arange(k)[:, None]).astype(np.int64)
    counts += mine.sum(axis=1)
    sums += dot(mine, points[rows])
    return counts, sums, whole, single


def clean_vectors(vectors: DataFrame, size: int, scale: int) -> DataFrame:
    """vec_id and x (floor of scale times each component) of the rows whose vector has exactly `size` finite components."""
    fine = (F.size("embedding") == size) & F.forall("embedding", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c.cast("double")) * scale < MOST), F.lit(False)))
    return vectors.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda c: F.floor(c.cast("double") * scale).cast("int")).alias("x"))


def _planted(rows: DataFrame, size: int) -> DataFrame:
    """The trees: ids, points and nodes as bytes, and the number of levels. One an Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            tree = Tree(np.asarray(b.column(1).flatten()).reshape(-1, size).astype(np.int64))
            ids = b.column(0).take(pa.array(tree.order))
            columns = [pa.array([ids.to_pylist()], pa.list_(pa.int64())), *(pa.array([x.tobytes()], pa.binary()) for x in (tree.points.astype(np.int32), tree.nodes())), pa.array([tree.levels], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["ids", "points", "nodes", "levels"])

    return rows.mapInArrow(run, "ids array<long>, points binary, nodes binary, levels int")


def _trees(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, int]]:
    for b in batches:
        for r in range(b.num_rows):
            points = np.frombuffer(b.column(1)[r].as_buffer(), np.int32).reshape(-1, size).astype(np.int64)
            yield b.column(0)[r].values, points, np.frombuffer(b.column(2)[r].as_buffer(), np.int64).reshape(-1, 3, size), b.column(3)[r].as_py()


def _moved(trees: DataFrame, centres: list[list[int]]) -> list[list[int]]:
    """The centroids after one round: floor(sum / count) of their vectors; those without any stay."""
    at, size = np.array(centres, np.int64), len(centres[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(len(at), np.int64), np.zeros(at.shape, np.int64)
        for _, points, nodes, levels in _trees(batches, size):
            c, s, *_ = descend(points, nodes, levels, at)
            counts, sums = counts + c, sums + s
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts[held]), pa.array(list(sums[held]), pa.list_(pa.int64()))], names=["c", "n", "s"])

    parts = trees.mapInArrow(run, "c long, n long, s array<long>").select("c", "n", F.posexplode("s").alias("j", "s"))
    # One row a centroid and dimension.
    found = parts.groupBy("c", "j").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    out = [list(c) for c in centres]
    for r in found:
        out[r.c][r.j] = int(r.s) // r.n
    return out


def _assigned(trees: DataFrame, centres: list[list[int]]) -> DataFrame:
    at, size = np.array(centres, np.int64), len(centres[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, points, nodes, levels in _trees(batches, size):
            _, _, whole, of = descend(points, nodes, levels, at)
            for a, b, c in whole:
                of[a:b] = c
            away = points - at[of]
            yield pa.RecordBatch.from_arrays([ids, pa.array(of.astype(np.int32)), pa.array((away * away).sum(axis=1))], names=["vec_id", "cluster", "distance"])

    return trees.mapInArrow(run, "vec_id long, cluster int, distance long")


def kd_cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, size: int = 64, scale: int = 64, seed: int = 1) -> tuple[DataFrame, list[list[int]]]:
    """vec_id, cluster and distance (squared) of every row of vec_id, embedding that is kept, and the centroids.

    Kept are vectors of exactly `size` components, none null or non-finite; a component x counts as
    floor(scale * x). Those with one of 2 ** 26 or more in amount, whose distances would not fit a
    long, are left out too. The first centroids are the k vectors of the smallest lower-case hex
    sha256 of `seed:vec_id`, in that order; repeated vec_ids tie and stand in the order of their
    components. A null vec_id is clustered but starts no centroid. Of equally near centroids the
    smallest number counts. A centroid that loses all its vectors stays where it is. Repeated
    rows and vectors are all returned; fewer than k vectors give fewer centroids, an empty table no
    rows. Other columns are not read.
    """
    spark: SparkSession = vectors.sparkSession
    rows = materialize(clean_vectors(vectors, size, scale), "vectors")
    named = rows.where("vec_id is not null").withColumn("__key", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256))
    centres = [list(r.x) for r in named.orderBy("__key", "x").limit(k).collect()]
    if not centres:
        # Nothing to start from: vectors without vec_id alone are in no cluster.
        return rows.where("vec_id is not null").select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), []
    trees = materialize(_planted(rows, size), "trees")
    discard(rows)
    for _ in range(rounds):
        centres = _moved(trees, centres)
    out = materialize(_assigned(trees, centres), "assigned")
    discard(trees)
    return out, centres


def cluster_digest(vectors: DataFrame, **options: int) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every kept vector (see kd_cluster)."""
    found, centres = kd_cluster(vectors, **options)
    sums = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()  # at most k rows
    total = sum(r.cluster_inertia for r in sums)
    digests = [(r.cluster, r.cluster_inertia, total, hashlib.sha256(",".join(map(str, centres[r.cluster])).encode()).hexdigest()) for r in sums]
    known = vectors.sparkSession.createDataFrame(digests, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
