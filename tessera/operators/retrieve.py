"""The four retrieval modes over batches of queries, and a product's knowledge base."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.config import MODES, RetrievalConfig
from tessera.functions.text import with_path
from tessera.operators.bm25 import bm25_best, bm25_search
from tessera.operators.catalog import get_document, list_topics
from tessera.operators.fusion import fuse, lexical_rerank, rerank, route
from tessera.operators.keyword_index import KeywordIndex
from tessera.operators.vector import cosine_search
from tessera.session import materialize

Reranker = Callable[[Column, Column], Column]


def retrieve(chunks: DataFrame, vectors: DataFrame, queries: DataFrame, mode: str = "hybrid_rerank", k: int = 10, product: str | None = None, doc_ids: list[str] | None = None, cfg: RetrievalConfig | None = None, reranker: Reranker = lexical_rerank, key: str = "chunk_id", product_col: str = "product", doc_col: str = "doc_id", index: KeywordIndex | None = None) -> DataFrame:
    """(query_id, key, score, rank, mode) for queries (query_id, query, q_vec): one plan for the whole batch.

    chunks: key, product, doc_id, text and, if any, section_path; vectors: key, product, doc_id, embedding.
    With a stored index (product and doc_id kept) the keyword leg reads that in place of the chunks' texts.
    """
    cfg = cfg or RetrievalConfig()
    words = chunks if index is None else index
    scope = {"product": product, "doc_ids": doc_ids, "key": key, "product_col": product_col, "doc_col": doc_col}
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; one of {', '.join(MODES)}")
    if mode == "keyword_only":
        out = bm25_search(words, queries, k, **scope)
    elif mode == "vector_only":
        out = cosine_search(vectors, queries, k, **scope)
    elif mode == "hybrid":
        depth = max(k, cfg.pool_depth)
        routed = route(queries, cfg, words, key) if cfg.hybrid_fusion == "adaptive" else None
        out = fuse(bm25_search(words, queries, depth, **scope), cosine_search(vectors, queries, depth, **scope), k, cfg, routed, key)
    else:
        pool = "vector_only" if cfg.rerank_pool == "vector" else "hybrid"
        found = retrieve(chunks, vectors, queries, pool, cfg.rerank_candidates, cfg=cfg, index=index, **scope).drop("mode")
        path = F.col("section_path") if "section_path" in chunks.columns else F.lit(None).cast("array<string>")
        text = with_path(path, F.col("text"), cfg.rerank_include_path)
        # Texts are read for the candidates alone: at most rerank_candidates a query, which go to the texts.
        pairs = F.broadcast(found).join(chunks.select(key, text.alias("passage")), key).join(queries.select("query_id", "query"), "query_id")
        out = rerank(pairs, k, cfg.retrieval_min_rerank_score, reranker(F.col("query"), F.col("passage")), key)
    return out.select("query_id", key, "score", "rank", F.lit(mode).alias("mode"))


def retrieve_modes(chunks: DataFrame, vectors: DataFrame, queries: DataFrame, k: int = 10, cfg: RetrievalConfig | None = None, reranker: Reranker = lexical_rerank, key: str = "chunk_id", index: KeywordIndex | None = None) -> DataFrame:
    """What `retrieve` gives in each of the four modes, without filters, from one pair of legs, which are written once."""
    cfg = cfg or RetrievalConfig()
    words = chunks if index is None else index
    hybrid, pool = max(k, cfg.pool_depth), max(cfg.rerank_candidates, cfg.pool_depth)
    most = max(hybrid, pool)
    legs = [materialize(leg.select("query_id", key, "score", "rank"), "leg") for leg in (bm25_best(words, queries, most, key), cosine_search(vectors, queries, most, key))]
    routed = materialize(route(queries, cfg, words, key), "routed") if cfg.hybrid_fusion == "adaptive" else None
    upto = lambda leg, n: leg.where(F.col("rank") <= n)
    fused = lambda depth, n: fuse(upto(legs[0], depth), upto(legs[1], depth), n, cfg, routed, key)
    found = upto(legs[1], cfg.rerank_candidates) if cfg.rerank_pool == "vector" else fused(pool, cfg.rerank_candidates)
    path = F.col("section_path") if "section_path" in chunks.columns else F.lit(None).cast("array<string>")
    texts = chunks.select(key, with_path(path, F.col("text"), cfg.rerank_include_path).alias("passage"))
    pairs = F.broadcast(found).join(texts, key).join(queries.select("query_id", "query"), "query_id")
    ranked = rerank(pairs, k, cfg.retrieval_min_rerank_score, reranker(F.col("query"), F.col("passage")), key)
    out = None
    for mode, rows in zip(MODES, (upto(legs[0], k), upto(legs[1], k), fused(hybrid, k), ranked), strict=True):
        rows = rows.select("query_id", key, "score", "rank", F.lit(mode).alias("mode"))
        out = rows if out is None else out.unionByName(rows)
    return out


@dataclass
class KnowledgeBase:
    """One product's search, document and topic tools. scopes names lists of doc_ids (modules)."""

    chunks: DataFrame
    vectors: DataFrame
    product: str
    scopes: dict[str, list[str]] = field(default_factory=dict)
    cfg: RetrievalConfig = field(default_factory=RetrievalConfig)
    index: KeywordIndex | None = None

    def search(self, queries: DataFrame, k: int = 5, mode: str = "hybrid_rerank", scope: str | None = None) -> DataFrame:
        found = retrieve(self.chunks, self.vectors, queries, mode, k, self.product, self.scopes.get(scope or "", []), self.cfg, index=self.index)
        return F.broadcast(found).join(self.chunks, "chunk_id")  # k rows a query

    def get_document(self, doc_id: str) -> DataFrame:
        return get_document(self.chunks.where(F.col("product") == self.product), doc_id)

    def list_topics(self) -> DataFrame:
        return list_topics(self.chunks.where(F.col("product") == self.product))

    def tools(self) -> list[str]:
        """Names of the tools, each with the product before it."""
        names = ["search_docs", *(f"search_{s}" for s in self.scopes), "get_document", "list_topics"]
        return [f"{self.product}_{n}" for n in names]


def tool_registry(bases: list[KnowledgeBase]) -> DataFrame:
    """(tool, product, original): what a router looks up for a tool name."""
    spark = bases[0].chunks.sparkSession
    return spark.createDataFrame([(t, b.product, t[len(b.product) + 1 :]) for b in bases for t in b.tools()], "tool string, product string, original string")


def product_rows(bases: list[KnowledgeBase], ports: dict[str, int]) -> DataFrame:
    """(product, port, tool, doc_ids) of every tool of every product: what a deployment is made from. doc_ids: the module a search is narrowed to, else empty."""
    rows = [(b.product, ports.get(b.product), t, b.scopes.get(t.split("_search_", 1)[-1], []) if "_search_" in t else []) for b in bases for t in b.tools()]
    return bases[0].chunks.sparkSession.createDataFrame(rows, "product string, port int, tool string, doc_ids array<string>")


def keyword_router(queries: DataFrame, products: dict[str, list[str]]) -> DataFrame:
    """(query_id, product): the deterministic stand-in for a model's choice of tools: products whose keywords stand in the query; all if none."""
    low = F.lower(F.col("query"))
    hit = [F.when(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w)), F.lit(p)) for p, words in products.items()]
    found = F.filter(F.array(*hit), lambda x: x.isNotNull())
    return queries.select("query_id", F.explode(F.when(F.size(found) > 0, found).otherwise(F.array(*map(F.lit, products)))).alias("product"))
