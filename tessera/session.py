"""Session factory and scratch tables shared by the engine's multi-step plans."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark drops the exchange files of a query when it ends, instead of when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes at most of the rows that Spark hands to a Python worker at once: 64 MB by Spark's default, held by both sides and, with room to grow, twice in Arrow's vectors.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20
_scopes: list[list[DataFrame]] = []


def local_session(cpus: int | str = "*", partitions: int = 8, app: str = "tessera") -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("TESSERA_DRIVER_MEMORY", "8g"))
        .config("spark.checkpoint.dir", os.path.join(tempfile.gettempdir(), "tessera-scratch"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a local session gets a temporary one and any other an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(os.path.join(tempfile.gettempdir(), "tessera-scratch"))
        base = spark.sparkContext.getCheckpointDir()
    return str(base).rstrip("/")


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder; it goes when the driver ends."""
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    fs, p = _hadoop(spark, path)
    fs.deleteOnExit(p)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage and survives lost executors.

    The table goes with `discard`, with the scope it was made in, or when the driver ends.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    if _scopes:
        _scopes[-1].append(out)
    return out


def small_batches(spark: SparkSession) -> None:
    """From now on this session hands BATCH_BYTES of rows to Python at once, as frames run after the call that made them. A number that is set already stays."""
    if spark.conf.get(BATCH, None) is None:
        spark.conf.set(BATCH, str(BATCH_BYTES))


@contextmanager
def small_splits(spark: SparkSession, most: int) -> Iterator[None]:
    """What runs meanwhile reads files in splits of `most` bytes at most; a smaller number of the session stays."""
    key = "spark.sql.files.maxPartitionBytes"
    before, now = spark.conf.get(key, None), spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    spark.conf.set(key, str(min(most, now)))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def discard(*frames: DataFrame) -> None:
    """Delete materialized tables that nothing reads any more."""
    for df in frames:
        if path := getattr(df, "_scratch_path", None):
            fs, p = _hadoop(df.sparkSession, path)
            fs.delete(p, True)
            fs.cancelDeleteOnExit(p)


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What `make` returns, written; the tables it wrote on its way are deleted."""
    _scopes.append([])
    try:
        frame = make()
    finally:
        made = _scopes.pop()
    out = materialize(frame, name)
    discard(*made)
    return out
