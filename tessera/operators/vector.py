"""Vector leg: exact cosine search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tessera.operators.bm25 import PLACES, scoped, top_k


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def check_dim(vectors: DataFrame, dim: int, column: str = "embedding") -> DataFrame:
    """The table, failing on a vector of another length."""
    return vectors.where(F.assert_true(F.size(column) == dim, F.lit(f"vector length is not {dim}")).isNull())


def cosine_search(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "chunk_id", product: str | None = None, doc_ids: list[str] | None = None, product_col: str = "product", doc_col: str = "doc_id", max_queries: int = 20_000) -> DataFrame:
    """(query_id, key, score, rank): the k nearest vectors of each query, filters inside the search.

    The queries (query_id, q_vec) go to all vectors as one matrix; their number is checked, and
    a larger set takes several passes. Every batch keeps its k best, so that only those are exchanged.
    Vectors that are null or hold a null are no hits; one of another length than the queries' is an error.
    """
    pool = usable(scoped(vectors, product, doc_ids, product_col, doc_col)).select(key, "embedding")
    out = None
    for ids, q in query_blocks(queries, max_queries):
        found = top_k(pool.mapInArrow(_nearest(ids, q, k, key), hit_schema(queries, vectors, key)), k, key)
        out = found if out is None else out.union(found)
    return out


def usable(vectors: DataFrame) -> DataFrame:
    return vectors.where(F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull()))


def hit_schema(queries: DataFrame, vectors: DataFrame, key: str) -> StructType:
    return StructType([queries.schema["query_id"], vectors.schema[key], StructField("score", DoubleType())])


def unit_rows(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), 1e-300)


def query_blocks(queries: DataFrame, most: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and unit vectors of the queries that have one, in blocks of about `most`; one empty block if there are none."""
    rows = queries.select("query_id", F.col("q_vec").cast("array<double>").alias("q")).where("q is not null")
    parts = max(1, -(-rows.count() // most))
    for part in range(parts):
        chunk = rows.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part).orderBy("query_id").toArrow()
        ids = chunk["query_id"].combine_chunks()
        yield ids, unit_rows(np.array(chunk["q"].to_pylist(), float).reshape(len(ids), -1 if len(ids) else 0))


def matrix(lists: pa.Array, dim: int) -> np.ndarray:
    """Unit rows of a column of vectors."""
    if (lists.value_lengths().to_numpy() != dim).any():
        raise ValueError(f"vector length is not {dim}")
    return unit_rows(np.asarray(lists.flatten(), float).reshape(-1, dim))


def best_of_batch(ids: pa.Array, q: np.ndarray, keys: pa.Array, v: np.ndarray, k: int, key: str) -> Iterator[pa.RecordBatch]:
    """Each query's k best of a batch of unit vectors, ties by key; one batch of hits for a block of queries."""
    rank = np.argsort(np.argsort(np.array(keys.to_pylist(), dtype=object), kind="stable"), kind="stable")
    for at in range(0, len(q), 256):
        s = np.round(q[at : at + 256] @ v.T, PLACES)
        rows, hits = [], []
        for i, row in enumerate(s):
            near = np.arange(len(row))
            if len(row) > k:  # ties at the border
                near = np.flatnonzero(row >= -np.partition(-row, k - 1)[k - 1])
                near = near[np.lexsort((rank[near], -row[near]))][:k]
            rows.append(np.full(len(near), i))
            hits.append(near)
        i, near = np.concatenate(rows), np.concatenate(hits)
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(at + i)), keys.take(pa.array(near)), pa.array(s[i, near])], names=["query_id", key, "score"])


def _nearest(ids: pa.Array, q: np.ndarray, k: int, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows and len(q):
                yield from best_of_batch(ids, q, b.column(0), matrix(b.column(1), q.shape[1]), k, key)

    return run
