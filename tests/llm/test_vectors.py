"""Clustering and whitening against plain restatements, with odd rows."""

import hashlib
import math
import random

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import kdcluster as kd
from tessera.llm.whitening import whiten

SCHEMA = "vec_id long, embedding array<float>, x int, row string, cluster int"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, e, 7, "own", 1) for i, e in rows], SCHEMA).repartition(parts)


def good(e, size=None):
    return e is not None and (size is None or len(e) == size) and all(c is not None and math.isfinite(c) for c in e)


def clusters(rows, k, size, scale=64, rounds=3):
    """Lloyd rounds in whole numbers; per row (id, cluster, distance) and the centroids."""
    kept = [(i, [math.floor(scale * c) for c in e]) for i, e in rows if good(e, size)]
    centres = [x for _, _, x in sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), n, x) for n, (i, x) in enumerate(sorted(kept, key=lambda r: r[1])) if i is not None)][:k]

    def near(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), n) for n, c in enumerate(centres))

    for _ in range(rounds):
        of = [near(x)[1] for _, x in kept]
        centres = [[sum(x[j] for x in mine) // len(mine) for j in range(size)] if (mine := [x for (_, x), o in zip(kept, of, strict=True) if o == n]) else c for n, c in enumerate(centres)]
    return [(i, *near(x)[::-1]) for i, x in kept], centres


def vector_rows(rng, n, size):
    middles = [[rng.gauss(0, 1) for _ in range(size)] for _ in range(6)]
    rows = [(i * 3 - 50, [float(np.float32(m + rng.gauss(0, 0.3))) for m in rng.choice(middles)]) for i in range(n)]
    return rows + [(1000, None), (1001, [None] + [0.5] * (size - 1)), (1002, [float("nan")] * size), (1003, [float("inf")] * size), (1004, [0.1] * (size - 1)), (1005, []), (None, [0.25] * size), (5000, [0.25] * size), (5000, [0.25] * size), (5001, [0.25] * size)]


def test_clusters_equal_plain_rounds(spark):
    for size, k in ((3, 5), (64, 16)):
        rows = vector_rows(random.Random(size), 300, size)
        found, centres = kd.kd_cluster(frame(spark, rows), k=k, size=size)
        want, at = clusters(rows, k, size)
        assert centres == at
        assert sorted(map(str, found.select("vec_id", "cluster", "distance").collect())) == sorted(f"Row(vec_id={a}, cluster={b}, distance={c})" for a, b, c in want)


def test_clusters_of_ties_few_and_no_vectors(spark):
    """Equal vectors share their cluster, fewer vectors than centroids give fewer centroids, and a grid has points between centroids."""
    grid = [(i, [float(x) / 64, float(y) / 64]) for i, (x, y) in enumerate((x, y) for x in range(9) for y in range(9))] + [(200 + i, [0.0, 0.0]) for i in range(60)]
    for rows, k in ((grid, 4), (grid[:2], 16), (grid[:1] * 5, 3), ([], 4), ([(None, [0.5, 0.5])], 4)):
        found, centres = kd.kd_cluster(frame(spark, rows), k=k, size=2)
        want, at = clusters(rows, k, 2) if any(i is not None for i, _ in rows) else ([], [])
        assert centres == at
        assert sorted(tuple(r) for r in found.collect()) == sorted(want)
        assert kd.cluster_digest(frame(spark, rows), k=k, size=2).count() == len(want)


def test_trees_prune_and_assign_whole_nodes(spark):
    """Far groups: most vectors are assigned with their nodes, and every count and sum is that of plain assignment."""
    rng = np.random.default_rng(4)
    points = np.concatenate([rng.integers(-9, 9, (500, 4)) + 400 * z for z in range(4)]).astype(np.int64)
    centres = np.array([[400 * z] * 4 for z in range(4)] + [[-5000] * 4], np.int64)
    tree = kd.Tree(points.copy())
    assert (tree.points == points[tree.order]).all()
    counts, sums, whole, single = kd.descend(tree.points, tree.nodes(), tree.levels, centres)
    plain = ((tree.points[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
    assert counts.tolist() == np.bincount(plain, minlength=5).tolist()
    assert (sums == np.array([tree.points[plain == z].sum(axis=0) for z in range(5)])).all()
    assert sum(b - a for a, b, _ in whole) + (single >= 0).sum() == 2000 and (single >= 0).sum() < 200
    big = np.full((3, 64), 1 << 26, np.int64)
    assert (kd.dot(big, big.T) == 64 << 52).all()


def whitened(rows, size, components=8):
    x = np.array([[math.floor(1024 * c) + 100000 for c in e] for _, e in rows if good(e, size)], dtype=object)
    n, s = len(x), x.sum(axis=0)
    away = (n * x - s).astype(float) / n
    e, u = np.linalg.eigh(away.T @ away / n)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    return n, ((n * x - s) ** 2).sum(axis=1).tolist(), away @ u / np.sqrt(e), e / np.trace(away.T @ away / n)


def test_whitening_equals_plain_linear_algebra(spark):
    for size in (3, 40):
        rows = vector_rows(random.Random(size), 200, size)
        got = whiten(frame(spark, rows)).collect()
        n, deviation, w, part = whitened(rows, size)
        k = w.shape[1]
        ids = [i for i, e in rows if good(e, size)]
        assert len(got) == n * k and {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
        for c in range(k):
            mine = sorted((str(r.vec_id), r.deviation, r.whitened) for r in got if r.component == c + 1)
            want = sorted((str(i), d, x) for i, d, x in zip(ids, deviation, w[:, c], strict=True))
            assert [m[:2] for m in mine] == [m[:2] for m in want]
            a, b = (np.array([m[2] for m in x]) for x in (mine, want))
            assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-8
            assert all(abs(r.explained - part[c]) < 1e-9 for r in got if r.component == c + 1)


def test_whitening_without_variance(spark):
    """Equal vectors, one vector, no vector: no direction holds variance."""
    for rows in ([(i, [0.5, 0.25]) for i in range(4)], [(1, [0.5, 0.25])]):
        got = whiten(frame(spark, rows)).collect()
        assert len(got) == 2 * len(rows) and all(r.whitened is None and r.explained == 0 and r.identity_error is None and r.deviation == 0 for r in got)
    assert whiten(frame(spark, [])).collect() == [] and whiten(frame(spark, [(1, None), (2, [])])).collect() == []
    flat = whiten(frame(spark, [(i, [float(i), 1.0, 2.0 * i]) for i in range(9)])).where("vec_id = 3").orderBy("component").collect()
    assert [r.whitened is None for r in flat] == [False, True, True] and abs(flat[0].explained - 1) < 1e-9
    huge = whiten(frame(spark, [(1, [2.0**30]), (2, [-(2.0**30)]), (3, [0.0])])).collect()
    assert [r.deviation for r in sorted(huge, key=lambda r: r.vec_id)] == [None, None, 0]
