"""Deterministic stand-ins for embedding services, and retries around any provider call."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from typing import TypeVar

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from tessera.functions.text import index_tokens

T = TypeVar("T")


def hash_embedding(text: Column, dim: int = 64) -> Column:
    """A unit vector of hashed terms, in built-in functions: the default embedder for documents and queries alike."""
    terms = index_tokens(text)
    slot = lambda t: F.pmod(F.xxhash64(t), F.lit(dim))
    counts = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(terms, lambda t: slot(t) == i)).cast("double"))
    norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(counts, lambda x: F.when(norm > 0, x / norm).otherwise(0.0).cast("float"))


def embed_with(df: DataFrame, text: str, embed: Callable[[list[str]], list[list[float]]], dim: int, batch: int = 128, column: str = "embedding") -> DataFrame:
    """The table with vectors of a provider: texts go in batches of at most `batch`, lengths are checked."""
    schema = StructType([*df.schema.fields, StructField(column, ArrayType(FloatType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts, out = b[text].fillna("").tolist(), []
            for i in range(0, len(texts), batch):
                got = embed(texts[i : i + batch])
                if len(got) != len(texts[i : i + batch]) or any(len(v) != dim for v in got):
                    raise ValueError("the embedder returned vectors of another number or length")
                out += [np.asarray(v, np.float32).tolist() for v in got]
            yield b.assign(**{column: out})

    return df.mapInPandas(run, schema)


def with_retry(call: Callable[[], T], retryable: tuple[type[Exception], ...], attempts: int = 6, base: float = 0.5, sleep: Callable[[float], None] = time.sleep) -> T:
    """The call's result; retryable errors are tried again after growing waits with jitter, others go up at once."""
    for i in range(attempts):
        try:
            return call()
        except retryable:
            if i == attempts - 1:
                raise
            sleep(base * 2**i * (1 + random.random()))
    raise AssertionError
