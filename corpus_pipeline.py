"""The corpus pipeline: each stage calls one operator of tessera.llm on all that its predecessor kept.

All stages but the last return the columns of documents, whatever they are; names of the
operators' own columns get a prefix there that none of them begins with.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.decontam import without_leaks
from tessera.llm.linear import free_prefix
from tessera.llm.mixing import mix
from tessera.llm.neardup import near_duplicates
from tessera.llm.quality import fit_quality, score_quality
from tessera.llm.sharding import jump_shard
from tessera.session import discard, materialize, settled, small_batches
from tessera.sources.tables import table


def _own(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents of a quality score below 0.5 go. Learnt from all labelled rows of documents (a bounded sample).
    Null and empty texts have the score of the model's intercept, repeated rows their common score; an empty table stays empty."""
    small_batches(spark)
    weights, bias = fit_quality(docs, table(spark, sf_dir, "labels"))
    score = free_prefix(docs) + "score"
    return score_quality(docs, weights, bias, _own(docs), score).where(F.col(score) >= 0.5).drop(score)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: five-word shingles, similarity of 0.8 or more; of each group the document of the smallest
    doc_id stays. Rows that repeat doc_id and text count once, the one of the smallest JSON; rows that repeat
    doc_id alone are told apart by their text. Those without doc_id stay if no other is in their group."""
    small_batches(spark)
    p = free_prefix(docs)
    marked = docs.withColumns({p + "text": F.xxhash64("text"), p + "id": F.col("doc_id").cast("long")})
    found = near_duplicates(docs, 5, 4, 5, text_hash=True).where("kept").select(F.col("doc_id").alias(p + "of"), F.col("text_hash").alias(p + "hash")).distinct()
    same = lambda t: F.col(p + "id").eqNullSafe(t[p + "of"]) & (F.col(p + "text") == t[p + "hash"])
    kept = marked.join(found, same(found), "left_semi")
    again = kept.groupBy(F.col(p + "id").alias(p + "of"), F.col(p + "text").alias(p + "hash")).agg(F.count("*").alias(p + "n")).where(F.col(p + "n") > 1)
    again = materialize(again.select(p + "of", p + "hash"), "again")
    # Only rows that repeat both are grouped with all their columns; of those the one of the smallest JSON stays, as not all types have an order.
    once = kept.join(again, same(again), "left_anti").select(*_own(docs))
    row = F.struct(*_own(docs))
    first = kept.join(again, same(again), "left_semi").groupBy(p + "id", p + "text").agg(F.min_by(row, F.to_json(row)).alias(p + "row"))
    return once.unionByName(first.select(f"{p}row.*").select(*_own(docs)))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents that hold a benchmark item go. Null and empty texts hold none; repeated rows go or stay together."""
    small_batches(spark)
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: each document stands as often as its rate says: not at all, once or more. The domains are
    learnt from the whole documents table, as the stages before have taken most of the poor ones away."""
    small_batches(spark)
    p = free_prefix(docs)
    mixed = mix(docs, table(spark, sf_dir, "labels"), columns=_own(docs), prefix=p, learn=table(spark, sf_dir, "documents"))
    return mixed.select(*_own(docs), F.explode(F.array_repeat(F.lit(0), F.col(p + "copies"))).alias(p + "copy")).drop(p + "copy")


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: the columns of documents and a shard from 0 to 23 (in place of one of that name). The shard is that of doc_id
    (null: of 0), whatever the text; repeated rows share it."""
    return docs.withColumn("shard", jump_shard(F.col("doc_id"), 24))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

#: The stages hold trained models and graph components, which SQL cannot express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, settled(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
