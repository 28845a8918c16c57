"""Fusion of the two legs, the per-query router, and reranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.config import RetrievalConfig
from tessera.functions.text import content_tokens, index_tokens, is_lexical, query_tokens
from tessera.operators.bm25 import token_df
from tessera.operators.keyword_index import KeywordIndex


def _legs(bm25: DataFrame, vector: DataFrame, key: str) -> DataFrame:
    """Outer join of the legs (query_id, key, score, rank)."""
    b = bm25.select("query_id", key, F.col("score").alias("b_score"), F.col("rank").alias("b_rank"))
    v = vector.select("query_id", key, F.col("score").alias("v_score"), F.col("rank").alias("v_rank"))
    return b.join(v, ["query_id", key], "full_outer")


def rrf(bm25: DataFrame, vector: DataFrame, k: int, key: str = "chunk_id", c: int = 60) -> DataFrame:
    """Reciprocal ranks summed over the legs; ties: vector hits by rank, then keyword hits."""
    part = lambda r: F.coalesce(1.0 / (c + F.col(r)), F.lit(0.0))
    rows = _legs(bm25, vector, key).withColumn("score", part("v_rank") + part("b_rank"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), F.coalesce("v_rank", F.col("b_rank") + 1_000_000)))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", key, "score", "rank")


def _norm(leg: DataFrame) -> DataFrame:
    """Scores over a leg's range; all 1 if the range is 0."""
    w = W.partitionBy("query_id")
    lo, hi = F.min("score").over(w), F.max("score").over(w)
    return leg.withColumn("lo", lo).withColumn("hi", hi).withColumn("score", F.when(F.col("hi") > F.col("lo"), (F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(1.0)).drop("lo", "hi")


def weighted(bm25: DataFrame, vector: DataFrame, k: int, alpha: DataFrame | float, key: str = "chunk_id") -> DataFrame:
    """alpha * vector + (1 - alpha) * keyword of the normalised legs; alpha is a number or a table (query_id, alpha).
    Absent is 0. Ties: keyword hits by rank, then vector hits by rank."""
    rows = _legs(_norm(bm25), _norm(vector), key)
    rows = rows.join(alpha, "query_id") if isinstance(alpha, DataFrame) else rows.withColumn("alpha", F.lit(float(alpha)))
    score = F.col("alpha") * F.coalesce("v_score", F.lit(0.0)) + (1 - F.col("alpha")) * F.coalesce("b_score", F.lit(0.0))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), F.coalesce("b_rank", F.col("v_rank") + 1_000_000)))
    return rows.withColumn("score", score).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", key, "score", "rank")


def route(queries: DataFrame, cfg: RetrievalConfig, chunks: DataFrame | KeywordIndex | None = None, key: str = "chunk_id") -> DataFrame:
    """(query_id, lexical, alpha): by an identifier in the query (regex), by a rare content token (idf), or by either (any other signal)."""
    by_regex = F.coalesce(is_lexical(F.col("query")), F.lit(False))
    if cfg.hybrid_adaptive_signal == "regex" or chunks is None:
        rows = queries.select("query_id", by_regex.alias("lexical"))
    else:
        rare = token_df(chunks, queries, key=key).groupBy("query_id").agg((F.min("df") <= cfg.hybrid_lex_df_max).alias("rare"))
        by_df = F.coalesce("rare", F.lit(False))
        lexical = by_df if cfg.hybrid_adaptive_signal == "idf" else by_df | by_regex
        rows = queries.join(rare, "query_id", "left").select("query_id", lexical.alias("lexical"))
    return rows.withColumn("alpha", F.when(F.col("lexical"), cfg.hybrid_alpha_lexical).otherwise(cfg.hybrid_alpha_semantic))


def fuse(bm25: DataFrame, vector: DataFrame, k: int, cfg: RetrievalConfig, routed: DataFrame | None = None, key: str = "chunk_id") -> DataFrame:
    if cfg.hybrid_fusion == "weighted":
        return weighted(bm25, vector, k, cfg.hybrid_alpha, key)
    if cfg.hybrid_fusion == "adaptive":
        return weighted(bm25, vector, k, routed.select("query_id", "alpha"), key)
    return rrf(bm25, vector, k, key, cfg.rrf_k)


def lexical_rerank(query: Column, text: Column) -> Column:
    """The default reranker: share of the query's distinct terms that the text holds. Any column of scores may stand in."""
    terms = F.array_distinct(F.flatten(F.transform(content_tokens(query), index_tokens)))
    return F.when(F.size(terms) > 0, F.size(F.array_intersect(terms, index_tokens(text))) / F.size(terms)).otherwise(0.0)


def rerank(candidates: DataFrame, k: int, floor: float, score: Column, key: str = "chunk_id") -> DataFrame:
    """The k best candidates (query_id, key, rank, columns of `score`) by the reranker, and of those the ones that reach
    the floor; nothing moves up. A floor of 0 or less is none. Ties keep the candidates' order."""
    rows = candidates.withColumn("first_rank", F.col("rank")).withColumn("score", score)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "first_rank"))
    rows = rows.withColumn("rank", rank).where(F.col("rank") <= k)
    return rows.where(F.col("score") >= floor) if floor > 0 else rows


__all__ = ["fuse", "lexical_rerank", "query_tokens", "rerank", "route", "rrf", "weighted"]
