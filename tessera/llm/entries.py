"""The queries of the training-data operators: thin digests over their operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.decontam import find_leaks
from tessera.llm.gifmedia import media_digest, store_texts
from tessera.llm.jaccardjoin import jaccard_join
from tessera.llm.kdcluster import cluster_digest
from tessera.llm.langid import fit_langid, predict_languages
from tessera.llm.licenses import scan_licenses
from tessera.llm.linear import held
from tessera.llm.mixing import mix
from tessera.llm.neardup import near_duplicates
from tessera.llm.oracles import SQL
from tessera.llm.quality import fit_quality, score_quality
from tessera.llm.sharding import shard_documents
from tessera.llm.suffixdedup import remove_repeats
from tessera.llm.toxicity import fit_toxicity, score_toxicity
from tessera.llm.whitening import whiten
from tessera.sources.tables import table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = table(spark, sf_dir, "documents"), held("doc_id", 4, 2)
    model = fit_langid(docs, ~out)
    return predict_languages(docs, model, [F.col("doc_id"), out.alias("held_out")])


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), 3, 85, 100)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, held_out (crc32 of doc_id mod 3 is 1: not learnt from), p_1, p_2, severity, toxic, grade."""
    docs, out = table(spark, sf_dir, "documents"), held("doc_id", 3, 1)
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"), ~out)
    return score_toxicity(docs, model, [F.col("doc_id"), out.alias("held_out")])


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = table(spark, sf_dir, "documents"), held("doc_id", 3, 1)
    weights, bias = fit_quality(docs, table(spark, sf_dir, "labels"), ~out)
    scored = score_quality(docs, weights, bias, [F.col("doc_id"), out.alias("held_out")])
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(table(spark, sf_dir, "documents"), 100)
    return cut.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


def op8_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digest(store_texts(table(spark, sf_dir, "documents")))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, posteriors of the domains, tokens, rate and copies."""
    mixed = mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), columns=[F.col("doc_id")])
    return mixed.withColumnsRenamed({f"p_{c}": c for c in ("tokens", "rate", "copies")})


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document and benchmark item that meet: doc_id, item_id, similarity, n_places, first_word."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


def op11_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_digest(table(spark, sf_dir, "embeddings"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"), 3, 9, 10)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sharding": op1_sharding,
        "op2_language": op2_language,
        "op3_near_duplicates": op3_near_duplicates,
        "op4_toxicity": op4_toxicity,
        "op5_quality": op5_quality,
        "op6_repeats": op6_repeats,
        "op7_licenses": op7_licenses,
        "op8_gif": op8_gif,
        "op9_mixing": op9_mixing,
        "op10_decontamination": op10_decontamination,
        "op11_clustering": op11_clustering,
        "op12_whitening": op12_whitening,
        "op13_jaccard_join": op13_jaccard_join,
    }


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
