"""Structured Streaming: idempotent incremental ingest, reduction of answer events, and windowed event counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.streaming.bucket_store import BucketStore


def stream_ingest(spark: SparkSession, source: str, schema: str, transform: Callable[[DataFrame], DataFrame], store: BucketStore, checkpoint: str, files_per_batch: int = 8, replace: bool = False) -> StreamingQuery:
    """New files of `source` are transformed and upserted, all that is available and then stop.

    Each batch rewrites the buckets it meets. A replayed batch is known by the checkpoint's folder and its number and
    left out; the same files under another checkpoint change nothing either, as ids are deterministic. With `replace`
    a changed document's old chunks go.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true").parquet(source)
    return (
        stream.writeStream.foreachBatch(lambda df, n: store.merge(transform(df), replace, checkpoint, n) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def reduce_events(events: DataFrame, request: str = "request_id", order: str = "seq") -> DataFrame:
    """(request, answer, steps, done) of an append-only event log (type, payload): deltas joined in order, tool calls listed in order."""
    w = lambda kind: F.filter(F.array_sort(F.collect_list(F.struct(order, "type", "payload"))), lambda e: e["type"] == kind)
    text = lambda kind: F.transform(w(kind), lambda e: e["payload"])
    return events.groupBy(request).agg(F.array_join(text("answer_delta"), "").alias("answer"), text("tool_call").alias("steps"), (F.count_if(F.col("type") == "done") > 0).alias("done"))


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """(start, event_type, n, total) of an event stream or table by tumbling windows, late rows dropped after the watermark."""
    ts = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = ts.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return rows.select(F.col("window.start").alias("start"), "event_type", "n", "total")
