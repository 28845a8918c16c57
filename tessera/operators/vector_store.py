"""Stored vector collections: one a product, in segments, with the lists of an inverted file.

Folders under a path that all executors share:
  points/seg=N/product=P/list=L   key, payload, embedding; L is the list of the nearest centre (0 before training)
  gone/seg=N                      keys whose earlier points segment N replaces or removes
  whole/seg=N                     one row, written last: a segment counts only once it is whole
  lists/v=N                       the centres and the number of lists that a search probes
  meta                            key, schema, length of the vectors, products
An upsert writes what it brings. A search of a product reads that product's folders alone, and
with `probes` only the lists nearest to its queries, whose vectors it compares exactly.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, IntegerType, StringType, StructField, StructType

from tessera.operators.bm25 import top_k
from tessera.operators.vector import best_of_batch, hit_schema, matrix, query_blocks, unit_rows
from tessera.schema import PRODUCTS

#: Vectors that centres are fitted on at most, those of the smallest hashes; and how many of them stand in as queries to choose the probes.
MAX_SAMPLE, MAX_TRIALS = 20_000, 200
EMBEDDING = StructField("embedding", ArrayType(FloatType()))
LAYOUT = [StructField("product", StringType()), StructField("list", IntegerType()), StructField("seg", IntegerType())]


class VectorStore:
    """Made by `create`, found again by `open`. An object reads the segments it first saw and those it wrote."""

    def __init__(self, spark: SparkSession, path: str, meta: dict):
        self.spark, self.path = spark, path.rstrip("/")
        self.key, self.dim, self.products = meta["key"], int(meta["dim"]), list(meta["products"])
        self.payload = StructType.fromJson(json.loads(meta["schema"]))
        self.centres: np.ndarray | None = None
        self.probes = 0
        self._seen: list[int] | None = None
        self._load_lists()

    @classmethod
    def create(cls, spark: SparkSession, path: str, dim: int, payload: StructType, key: str = "chunk_id", products: tuple[str, ...] = PRODUCTS, recreate: bool = False) -> VectorStore:
        """The collections at this path, made if there are none; with `recreate` all vectors that stand there go first.

        payload: the key and the columns that are stored beside product and vector. An existing store must have the
        same length of vectors, key, products and payload.
        """
        fs, p = _fs(spark, path)
        if recreate:
            fs.delete(p, True)
        meta = {"key": key, "dim": dim, "products": list(products), "schema": payload.json()}
        if fs.exists(_fs(spark, f"{path.rstrip('/')}/meta/_SUCCESS")[1]):
            store = cls.open(spark, path)
            if (store.key, store.dim, store.products, store.payload) != (key, dim, list(products), payload):
                raise ValueError(f"{path} holds other collections")
            return store
        rows = spark.createDataFrame([(key, dim, list(products), payload.json())], "key string, dim int, products array<string>, schema string")
        rows.coalesce(1).write.mode("overwrite").json(f"{path.rstrip('/')}/meta")
        return cls(spark, path, meta)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> VectorStore:
        return cls(spark, path, spark.read.json(f"{path.rstrip('/')}/meta").first().asDict())

    # Segments

    def segments(self) -> list[int]:
        """Numbers of the whole segments."""
        if self._seen is None:
            fs, p = _fs(self.spark, f"{self.path}/whole")
            names = [s.getPath() for s in fs.listStatus(p)] if fs.exists(p) else []
            jp = self.spark._jvm.org.apache.hadoop.fs.Path
            self._seen = sorted(int(x.getName()[4:]) for x in names if x.getName().startswith("seg=") and fs.exists(jp(x, "_SUCCESS")))
        return self._seen

    def _read(self, name: str, fields: list[StructField]) -> DataFrame:
        """A table of the whole segments; names of others are not even listed."""
        if not self.segments():
            return self.spark.createDataFrame([], StructType(fields))
        paths = [f"{self.path}/{name}/seg={n}" for n in self.segments()]
        return self.spark.read.schema(StructType(fields)).option("basePath", f"{self.path}/{name}").parquet(*paths)

    def points(self, product: str | None = None) -> DataFrame:
        """The live points: key, payload, embedding, product and list."""
        rows = self._read("points", [*self.payload.fields, EMBEDDING, *LAYOUT])
        rows = rows if product is None else rows.where(F.col("product") == product)
        if len(self.segments()) > 1:
            gone = self._read("gone", [self.payload[self.key], LAYOUT[2]]).groupBy(self.key).agg(F.max("seg").alias("gone_at"))
            rows = rows.join(gone, self.key, "left").where("gone_at IS NULL OR gone_at <= seg").drop("gone_at")
        return rows.drop("seg")

    def count(self, product: str) -> int:
        return self.points(product).count()

    def upsert(self, chunks: DataFrame, vectors: DataFrame) -> None:
        """Points in place of those of the same key: chunks (key, product, payload) with vectors (key, embedding).

        Every chunk needs one vector and every vector one chunk, of the collections' length and products; else nothing is written.
        """
        both = chunks.select(self.key, "product", *(c for c in self.payload.names if c != self.key)).withColumn("in_chunks", F.lit(1))
        both = both.join(vectors.select(self.key, F.col("embedding").cast(EMBEDDING.dataType).alias("embedding")), self.key, "full_outer")
        wrong = (
            F.when(F.col("in_chunks").isNull() | F.col("embedding").isNull(), F.lit("chunks and vectors differ in number"))
            .when(F.size("embedding") != self.dim, F.concat(F.lit("vector length "), F.size("embedding").cast("string"), F.lit(f" is not {self.dim}")))
            .when(~F.coalesce(F.col("product").isin(self.products), F.lit(False)), F.concat(F.lit("no collection for product "), F.coalesce("product", F.lit("null"))))
        )
        if bad := both.select(wrong.alias("wrong")).where("wrong IS NOT NULL").first():
            raise ValueError(bad.wrong)
        self._write(both.drop("in_chunks"), chunks.select(self.key))

    def remove(self, keys: DataFrame) -> None:
        empty = self.spark.createDataFrame([], StructType([*self.payload.fields, EMBEDDING, LAYOUT[0]]))
        self._write(empty, keys.select(self.key))

    def _write(self, rows: DataFrame, gone: DataFrame) -> None:
        seg = (self.segments() or [-1])[-1] + 1
        self._store(rows, gone.distinct(), seg)
        self._seen = None

    def _store(self, rows: DataFrame, gone: DataFrame, seg: int) -> None:
        at = lambda name: f"{self.path}/{name}/seg={seg}"
        listed = self._assigned(rows.select(*self.payload.names, "embedding", "product"))
        listed.hint("rebalance", "product", "list").write.mode("overwrite").partitionBy("product", "list").parquet(at("points"))
        gone.write.mode("overwrite").parquet(at("gone"))
        self.spark.range(1).coalesce(1).write.mode("overwrite").parquet(at("whole"))

    def compact(self, path: str) -> VectorStore:
        """The same collections as one segment at another path, in the lists of the last training."""
        other = VectorStore.create(self.spark, path, self.dim, self.payload, self.key, tuple(self.products), recreate=True)
        other.centres, other.probes = self.centres, self.probes
        if self.centres is not None:
            other._save_lists(0)
        live = self.points()
        other._store(live, live.select(self.key).limit(0), 0)
        return other

    # Lists

    def _load_lists(self) -> None:
        fs, p = _fs(self.spark, f"{self.path}/lists")
        if not fs.exists(p):
            return
        jp = self.spark._jvm.org.apache.hadoop.fs.Path
        done = [int(s.getPath().getName()[2:]) for s in fs.listStatus(p) if fs.exists(jp(s.getPath(), "_SUCCESS"))]
        if done:
            rows = sorted(self.spark.read.parquet(f"{self.path}/lists/v={max(done)}").collect(), key=lambda r: r.no)  # one row a list
            self.centres, self.probes = np.array([r.centre for r in rows], float), rows[0].probes

    def _save_lists(self, version: int) -> None:
        rows = [(i, c.tolist(), self.probes) for i, c in enumerate(self.centres)]
        self.spark.createDataFrame(rows, "no int, centre array<double>, probes int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/lists/v={version}")

    def train(self, path: str, lists: int | None = None, target: float = 0.97, k: int = 10, sample: int = MAX_SAMPLE) -> VectorStore:
        """The collections at another path, laid out by lists: centres of k-means by angle on a bounded sample, every point assigned.

        lists: by default the root of the number of points. The probes are the fewest lists that hold a share of `target` of
        the k nearest of some sampled vectors in the sample, in each product too; `recall` measures them against all points.
        """
        live = self.points()
        n = live.count()
        chosen = live.select("embedding", "product").orderBy(F.xxhash64("embedding"), "embedding", "product").limit(sample).toArrow()
        v = matrix(chosen["embedding"].combine_chunks(), self.dim) if len(chosen) else np.zeros((0, self.dim))
        new = VectorStore.create(self.spark, path, self.dim, self.payload, self.key, tuple(self.products), recreate=True)
        if len(v):
            new.centres = k_means(v, min(lists or max(1, round(n**0.5)), len(v)))
            new.probes = enough_probes(v, np.array(chosen["product"].to_pylist(), str), new.centres, target, k)
            new._save_lists(0)
        new._store(live, live.select(self.key).limit(0), 0)
        return new

    def _assigned(self, rows: DataFrame) -> DataFrame:
        if self.centres is None:
            return rows.withColumn("list", F.lit(0))
        centres, dim, at = self.centres, self.dim, rows.columns.index("embedding")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                near = (matrix(b.column(at), dim) @ centres.T).argmax(axis=1) if b.num_rows else np.zeros(0)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.astype(np.int32))], names=[*b.schema.names, "list"])

        return rows.mapInArrow(run, StructType([*rows.schema.fields, LAYOUT[1]]))

    # Search

    def search(self, queries: DataFrame, k: int = 10, product: str | None = None, doc_ids: list[str] | None = None, probes: int | None = 0, doc_col: str = "doc_id", max_queries: int = 20_000) -> DataFrame:
        """(query_id, key, score, rank): the k nearest points of each query (query_id, q_vec) in a product's collection, or in all.

        probes: how many lists each query looks into; None: as trained; 0, or as many as there are lists: all points, exactly.
        """
        probes = self.probes if probes is None else probes
        pool = self.points(product)
        pool = pool.where(F.col(doc_col).isin(*doc_ids)) if doc_ids else pool
        pool = pool.select(self.key, "embedding", "list")
        every = not probes or self.centres is None or probes >= len(self.centres)
        out = None
        for ids, q in query_blocks(queries, max_queries):
            if len(q) and q.shape[1] != self.dim:
                raise ValueError(f"query length {q.shape[1]} is not {self.dim}")
            asked = None if every or not len(q) else np.argsort(-(q @ self.centres.T), axis=1, kind="stable")[:, :probes]
            read = pool if asked is None else pool.where(F.col("list").isin(*np.unique(asked).tolist()))
            found = top_k(read.mapInArrow(self._compare(ids, q, asked, k), hit_schema(queries, pool, self.key)), k, self.key)
            out = found if out is None else out.union(found)
        return out

    def _compare(self, ids: pa.Array, q: np.ndarray, asked: np.ndarray | None, k: int):
        key, dim = self.key, self.dim

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows or not len(q):
                    continue
                v = matrix(b.column(1), dim)
                if asked is None:
                    yield from best_of_batch(ids, q, b.column(0), v, k, key)
                    continue
                of = b.column(2).to_numpy()
                for x in np.unique(of):
                    who = np.flatnonzero((asked == x).any(axis=1))
                    at = np.flatnonzero(of == x)
                    if len(who):
                        yield from best_of_batch(ids.take(pa.array(who)), q[who], b.column(0).take(pa.array(at)), v[at], k, key)

        return run

    def recall(self, queries: DataFrame, k: int = 10, probes: int | None = None, product: str | None = None) -> DataFrame:
        """One row: n queries, and the share of their exact k nearest points that a search by lists finds."""
        exact = self.search(queries, k, product)
        found = self.search(queries, k, product, probes=probes).select("query_id", self.key, F.lit(1).alias("found"))
        return exact.join(found, ["query_id", self.key], "left").agg(F.countDistinct("query_id").alias("n"), F.avg(F.coalesce("found", F.lit(0)).cast("double")).alias("recall"))


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def k_means(v: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k unit centres of unit vectors, by angle; a centre that loses all its vectors takes the one farthest from its own centre."""
    centres = v[:: max(1, len(v) // k)][:k].copy()
    for _ in range(rounds):
        s = v @ centres.T
        of, near = s.argmax(axis=1), s.max(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, v)
        empty = np.flatnonzero(np.bincount(of, minlength=k) == 0)
        sums[empty] = v[np.argsort(near, kind="stable")[: len(empty)]]
        centres = unit_rows(sums)
    return centres


def enough_probes(v: np.ndarray, products: np.ndarray, centres: np.ndarray, target: float, k: int) -> int:
    """The fewest lists that hold a share of `target` of the k nearest of sampled vectors, among all and in each product alone."""
    q = v[:: max(1, len(v) // MAX_TRIALS)][:MAX_TRIALS]
    place = np.argsort(np.argsort(-(q @ centres.T), axis=1, kind="stable"), axis=1, kind="stable")
    most = 0
    for mine in [np.ones(len(v), bool), *(products == p for p in np.unique(products))]:
        near = np.argsort(-(q @ v[mine].T), axis=1, kind="stable")[:, :k]
        of = (v[mine] @ centres.T).argmax(axis=1)
        needed = np.sort(np.take_along_axis(place, of[near], axis=1).ravel())
        most = max(most, int(needed[min(len(needed), max(1, int(np.ceil(target * len(needed))))) - 1]) + 1)
    return most
