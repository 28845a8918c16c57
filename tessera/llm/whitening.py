"""Embedding whitening from a tiled covariance.

Vectors are cut into column blocks of TILE dimensions; a pair of column blocks is a tile of the
covariance. Column blocks are exchanged by the run of rows they come from (a row-block); where
two meet they are centred and multiplied, and products are summed by tile. The tiles are
assembled to the covariance, whose eigenvectors turn the vectors in a second pass. What the
driver holds depends on the number of dimensions alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import discard, materialize

#: Dimensions of a column block.
TILE = 16
#: Components that are returned at most.
COMPONENTS = 8
#: Directions of less than this part of the largest eigenvalue hold no variance, but for rounding.
NULL_PART = 1e-12
#: Entries of this amount or more after scaling are left out, so that a batch's sums stay in a long.
MOST = 1 << 48


def whole_vectors(vectors: DataFrame, scale: int, shift: int) -> tuple[DataFrame, int]:
    """vec_id and x (floor of scale times each entry, plus shift) of the vectors without null or non-finite entries, of the
    length that most of them have; and that length."""
    fine = F.forall("embedding", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c.cast("double")) * scale < MOST), F.lit(False)))
    kept = vectors.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda c: F.floor(c.cast("double") * scale) + shift).alias("x"))
    size = kept.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    d = size.d if size else 0
    return kept.where(F.size("x") == d), d


def _matrix(lists: pa.Array, d: int) -> np.ndarray:
    return np.asarray(lists.flatten()).reshape(-1, d)


def sums_of(rows: DataFrame, d: int) -> tuple[int, list[int]]:
    """Number of rows and exact sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([_matrix(b.column(0), d).sum(axis=0)], pa.list_(pa.int64()))], names=["n", "s"])

    parts = rows.select("x").mapInArrow(run, "n long, s array<long>")
    found = parts.select("n", F.posexplode("s").alias("j", "s")).groupBy("j").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()  # one row a dimension
    total = [0] * d
    for r in found:
        total[r.j] = int(r.s)
    return (found[0].n if found else 0), total


def _column_blocks(rows: DataFrame, d: int, origin: np.ndarray) -> DataFrame:
    """(block, col, xs, width): one column block of one row-block, less the origin, as whole numbers of `width` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(1), d) - origin
            most = np.abs(x).max()
            x = x.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64)
            cols = range(0, d, TILE)
            # The first row's number names the row-block.
            name = pa.array([b.column(0)[0].as_py()] * len(cols), pa.int64())
            yield pa.RecordBatch.from_arrays([name, pa.array(range(len(cols)), pa.int32()), pa.array([np.ascontiguousarray(x[:, c : c + TILE]).tobytes() for c in cols], pa.binary()), pa.array([x.itemsize] * len(cols), pa.int32())], names=["block", "col", "xs", "width"])

    return rows.select("row", "x").mapInArrow(run, "block long, col int, xs binary, width int")


def covariance(rows: DataFrame, d: int, n: int, sums: list[int]) -> np.ndarray:
    """Covariance (divisor n) of the vectors, summed by tiles."""
    origin, rest = (np.array([f(s, n) for s in sums], np.int64) for f in (int.__floordiv__, int.__mod__))
    blocks = _column_blocks(rows, d, origin)
    side = lambda c, x, w: blocks.select("block", F.col("col").alias(c), F.col("xs").alias(x), F.col("width").alias(w))
    met = side("a", "xa", "wa").join(side("b", "xb", "wb"), "block").where("a <= b").select("a", "b", "xa", "wa", "xb", "wb")

    def centred(raw: pa.Buffer, width: int, col: int) -> np.ndarray:
        part = slice(col * TILE, min(d, (col + 1) * TILE))
        return np.frombuffer(raw, f"<i{width}").reshape(-1, part.stop - part.start) - rest[part] / n

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for a, b, xa, wa, xb, wb in zip(*(batch.column(i) for i in range(6)), strict=True):
                a, b = a.as_py(), b.as_py()
                tile = centred(xa.as_buffer(), wa.as_py(), a).T @ centred(xb.as_buffer(), wb.as_py(), b)
                tiles[a, b] = tiles[a, b] + tile if (a, b) in tiles else tile
        ends = [pa.array([k[i] for k in tiles], pa.int32()) for i in range(2)]
        yield pa.RecordBatch.from_arrays([*ends, pa.array([t.ravel() for t in tiles.values()], pa.list_(pa.float64()))], names=["a", "b", "tile"])

    tiles = met.mapInArrow(multiply, "a int, b int, tile array<double>")
    summed = tiles.select("a", "b", F.posexplode("tile").alias("at", "v")).groupBy("a", "b", "at").agg(F.sum("v").alias("v"))
    out = np.zeros((d, d))
    for r in summed.toLocalIterator():  # one row an entry of the covariance
        row, col = divmod(r["at"], min(TILE, d - r.b * TILE))
        i, j = r.a * TILE + row, r.b * TILE + col
        out[i, j] = out[j, i] = r.v / n
    return out


def eigen(v: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in falling order and unit eigenvectors as columns, the entry of the largest amount positive."""
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    return e, u * np.where(np.take_along_axis(u, np.abs(u).argmax(axis=0)[None], 0) < 0, -1.0, 1.0)


def whiten(vectors: DataFrame, scale: int = 1024, shift: int = 100_000, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of every vector that is kept, and component.

    Kept are vectors without null or non-finite entries; an entry c counts as x = floor(scale * c) +
    shift. n is their number, S their sums, V their covariance (divisor n). whitened is (x - S / n) on the unit
    eigenvector of V with the component-th largest eigenvalue e, over sqrt(e); the entry of the largest amount of an
    eigenvector is positive. explained is e / trace(V), identity_error the largest entry in amount of whitened's
    covariance less the identity, deviation the sum of (n * x - S) ** 2, exactly.

    All vectors should be of one length; those of another than most have (of equally frequent ones: the
    longest) and those with an entry of 2 ** 48 or more in amount after scaling are left out. Fewer dimensions give fewer components. A
    component without variance (all vectors equal, too few vectors) has whitened null, explained 0, and does not
    count in identity_error, which is null if there is no other. deviation is null where it does not fit a long. Repeated
    rows count and are returned each, also those without vec_id; an empty table gives no rows. Other columns are not read.
    """
    kept, d = whole_vectors(vectors, scale, shift)
    rows = materialize(kept.withColumn("row", F.monotonically_increasing_id()), "vectors")
    n, sums = sums_of(rows, d) if d else (0, [])
    schema = "vec_id long, deviation long, w array<double>"
    if not n:
        none = rows.where("false").select("vec_id", F.lit(1).alias("component"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("deviation"))
        return none.withColumns({c: F.lit(0.0) for c in ("whitened", "explained", "identity_error")})
    v = covariance(rows, d, n, sums)
    e, u = eigen(v, min(components, d))
    full = e > max(e[0], 0) * NULL_PART
    turn = u[:, full] / np.sqrt(e[full])
    # n * x - S as n * (x - origin) - rest, which stays small.
    origin, rest = (np.array([f(s, n) for s in sums], np.int64) for f in (int.__floordiv__, int.__mod__))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1), d) - origin
            away = x - rest / n
            # The sum wraps around like the ring it is in, so it is right whenever the true one fits.
            exact = ((n * x - rest) ** 2).sum(axis=1)
            fits = ((n * away) ** 2).sum(axis=1) < 2.0**63 * (1 - 1e-9)
            whitened = away @ turn
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * turn.shape[1]), pa.array(whitened.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(exact, mask=~fits), lists], names=["vec_id", "deviation", "w"])

    white = materialize(rows.select("vec_id", "x").mapInArrow(run, schema), "whitened")
    discard(rows)
    k = int(full.sum())
    error = None
    if k:
        col = lambda i: F.col("w")[i]
        mean = white.agg(*(F.avg(col(i)).alias(f"m{i}") for i in range(k))).first()
        at = [(i, j) for i in range(k) for j in range(i, k)]
        cov = white.agg(*(F.sum((col(i) - mean[i]) * (col(j) - mean[j])).alias(f"c{i}_{j}") for i, j in at)).first()
        error = max(abs(c / n - (i == j)) for (i, j), c in zip(at, cov, strict=True))
    place, trace = np.cumsum(full) - 1, float(np.trace(v))
    parts = [
        F.struct(
            F.lit(i + 1).alias("component"),
            (F.col("w")[int(place[i])] if full[i] else F.lit(None).cast("double")).alias("whitened"),
            F.lit(float(e[i]) / trace if full[i] else 0.0).alias("explained"),
        )
        for i in range(len(e))
    ]
    out = white.select("vec_id", F.lit(n).cast("long").alias("n"), "deviation", F.inline(F.array(*parts)))
    return out.select("vec_id", "component", "n", "deviation", "whitened", "explained", F.lit(error).cast("double").alias("identity_error"))
