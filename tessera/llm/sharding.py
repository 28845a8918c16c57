"""Sharding by jump consistent hashing, in Spark SQL expressions only.

A key's shard follows from the key and the shard count alone. Appending a shard moves
rows only into the new shard. No ring table and no state are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.session import materialize

#: Fixed values of the published jump consistent hash: the generator's multiplier and the word size.
JUMP_MULTIPLIER = 2862933555777941757
WORD = 18446744073709551616


def jump_shard(key: Column, shards: int) -> Column:
    """Shard 0..shards-1 of a long key; a null key counts as 0.

    The 64-bit generator runs in exact decimals, as a bigint product would overflow.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    start = F.struct(
        F.pmod(F.coalesce(key.cast("bigint"), F.lit(0)).cast("decimal(38,0)"), F.expr(f"{WORD}BD")).cast("decimal(20,0)").alias("k"),
        F.lit(-1).cast("bigint").alias("b"),
        F.lit(0).cast("bigint").alias("j"),
    )
    mult, one, word, high = (F.expr(f"{v}BD") for v in (JUMP_MULTIPLIER, 1, WORD, 8589934592))

    def advance(s: Column, _: Column) -> Column:
        k = F.pmod(s["k"] * mult + one, word).cast("decimal(20,0)")
        top = F.floor(k / high).cast("double")
        j = F.floor((s["j"] + 1).cast("double") * (F.lit(2147483648.0) / (top + 1.0))).cast("bigint")
        return F.when(s["j"] >= shards, s).otherwise(F.struct(k.alias("k"), s["j"].alias("b"), j.alias("j")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, advance, lambda s: s["b"].cast("int"))


def with_shards(df: DataFrame, shards: int, key: str = "doc_id", column: str = "shard") -> DataFrame:
    """The table with a shard column beside its own."""
    return df.withColumn(column, jump_shard(F.col(key), shards))


def shard_documents(docs: DataFrame, shards: int = 24, rows_per_task: int = 200_000) -> DataFrame:
    """Shard, size and gapless slot of every row of doc_id, text.

    Slots follow (doc_id, text_crc32, size) within a shard; equal rows take neighbouring
    slots in any order. They come from a range exchange and its per-partition counts, so no
    task holds a shard. Null text: size 8, crc32 of the empty string. Null doc_id: key 0,
    ordered first. Empty table: no rows. Other columns are not read.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        jump_shard(F.col("doc_id"), shards).alias("shard"),
        jump_shard(F.col("doc_id"), shards + 1).alias("grown_shard"),
    )
    spark = docs.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // rows_per_task))
    keys = ["shard", "doc_id", "text_crc32", "size"]
    # The last key only splits equal rows, which are interchangeable.
    placed = materialize(
        rows.withColumn("tie", F.xxhash64(F.monotonically_increasing_id()))
        .repartitionByRange(tasks, *keys, "tie")
        .sortWithinPartitions(*keys)
        .drop("tie")
        .withColumn("at", F.monotonically_increasing_id())
        .withColumn("part", F.spark_partition_id()),
        "shards",
    )
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    base = counts.select("shard", "part", (before - F.col("first")).alias("base"))
    return placed.join(base, ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("at") + F.col("base")).alias("slot"), "grown_shard"
    )
