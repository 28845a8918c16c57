"""Whole evaluation runs: retrieval over all modes, the rare-token slice, and traces of routed tool calls."""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tessera.config import MODES, RetrievalConfig
from tessera.functions.text import category, mentions, with_path
from tessera.operators.evals import by_bar, hit_rates, oov_summary, overall_and_by, report, summarize_results
from tessera.operators.retrieve import KnowledgeBase, retrieve
from tessera.session import materialize


def units(questions: DataFrame, vectors_of: DataFrame) -> DataFrame:
    """One unit for each question and expected product: query_id, product, query, q_vec, keywords, category."""
    rows = questions.withColumn("category", category(F.col("id"), F.col("tag"), F.col("expected_products"))).withColumn("product", F.explode("expected_products"))
    named = rows.select(F.concat_ws("|", "id", "product").alias("query_id"), "id", "product", "category", F.col("question").alias("query"), F.col("expected_section_keywords").alias("keywords"))
    return named.join(vectors_of.select("id", "q_vec"), "id", "left")


def retrieval_eval(units_: DataFrame, chunks: DataFrame, vectors: DataFrame, products: list[str], modes: tuple[str, ...] = MODES, k: int = 10, cfg: RetrievalConfig | None = None) -> DataFrame:
    """(query_id, category, product, mode, rank_text, rr_text, rank_section, rr_section) of every unit and mode.

    A unit searches its whole product. Units without any hit are kept with empty ranks.
    """
    found = []
    for product in products:
        q = units_.where(F.col("product") == product)
        found += [retrieve(chunks, vectors, q.select("query_id", "query", "q_vec"), m, k, product, cfg=cfg) for m in modes]
    hits = reduce(DataFrame.unionByName, found).join(chunks.select("chunk_id", "section_path", "text"), "chunk_id").join(units_.select("query_id", "keywords"), "query_id")
    path = F.array_join(F.coalesce("section_path", F.array().cast("array<string>")), " > ")
    first = lambda hay: F.min(F.when(mentions(hay, F.col("keywords")), F.col("rank")))
    ranks = hits.groupBy("query_id", "mode").agg(first(with_path(F.col("section_path"), F.col("text"))).alias("rank_text"), first(path).alias("rank_section"))
    every = units_.select("query_id", "category", "product").withColumn("mode", F.explode(F.array(*map(F.lit, modes))))
    inverse = lambda c: F.coalesce(1.0 / F.col(c), F.lit(0.0))
    return every.join(ranks, ["query_id", "mode"], "left").select("query_id", "category", "product", "mode", "rank_text", inverse("rank_text").alias("rr_text"), "rank_section", inverse("rank_section").alias("rr_section"))


def measured_runs(queries: DataFrame, runs: dict[str, Callable[[], DataFrame]]) -> DataFrame:
    """(query_id, run, hits, top, ms, queries, error) of named runs (modes, or single legs), each giving (query_id, score, ...).

    Every query has a row for every run: its number of hits and best score, the milliseconds of the whole run and how
    many queries shared them. A run that fails costs no other: its queries keep rows with the error and no hits.
    """
    n, ids = queries.count(), queries.select("query_id")
    out = None
    for name, make in runs.items():
        began, error, got, seen = time.perf_counter(), None, None, Observation()
        try:
            got = materialize(make().groupBy("query_id").agg(F.count("*").alias("hits"), F.max("score").alias("top")).observe(seen, F.count("*").alias("answered")), "run")
            if seen.get["answered"] > n:
                error = "hits of queries that were not asked"
        except Exception as e:  # noqa: BLE001 - whatever a provider or a plan raises becomes a row
            error = f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"
        ms = round((time.perf_counter() - began) * 1000, 1)
        rows = ids.join(got, "query_id", "left") if got is not None else ids.withColumns({"hits": F.lit(None).cast("long"), "top": F.lit(None).cast("double")})
        rows = rows.select("query_id", F.lit(name).alias("run"), F.coalesce("hits", F.lit(0)).alias("hits"), "top", F.lit(ms).alias("ms"), F.lit(n).alias("queries"), F.lit(error).cast("string").alias("error"))
        out = rows if out is None else out.unionByName(rows)
    return out


def run_summary(measured: DataFrame) -> DataFrame:
    """By run: queries, how many have hits, how many failed, and milliseconds in all and a query."""
    return measured.groupBy("run").agg(
        F.count("*").alias("n"), F.count_if(F.col("hits") > 0).alias("with_hits"), F.count("error").alias("failed"), F.max("ms").alias("ms"), (F.max("ms") / F.max("queries")).alias("ms_a_query")
    )


def scorecard(rows: DataFrame, cfg: RetrievalConfig | None = None) -> str:
    """Markdown: the configuration, both bars by mode, and each category by its own bar."""
    aggs: list[Column] = [F.count("*").alias("n"), F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))).alias("mrr")]
    barred = rows.withColumn("rank", by_bar(F.col("category"), F.col("rank_text"), F.col("rank_section")))
    stamp = ", ".join(f"{k}={v}" for k, v in (cfg or RetrievalConfig()).stamp().items())
    parts = [report(hit_rates(rows, ["mode"], rank=f"rank_{bar}"), f"{bar} bar", ["mode"]) for bar in ("text", "section")]
    return f"{stamp}\n\n" + "\n".join(parts) + "\n" + report(overall_and_by(barred, "mode", "category", aggs), "by category", ["category", "mode"])


def oov_eval(probes: DataFrame, chunks: DataFrame, vectors: DataFrame, products: list[str], k: int = 10, cfg: RetrievalConfig | None = None) -> DataFrame:
    """Misses and rescues over probes (query, product, token, q_vec): a hit holds the token in its path or text."""
    q = probes.select(F.concat_ws("|", "query", "product").alias("query_id"), "query", "product", "q_vec", F.array("token").alias("keywords"), F.lit("oov").alias("category"))
    rows = retrieval_eval(q, chunks, vectors, products, ("keyword_only", "vector_only", "hybrid_rerank"), k, cfg)
    return oov_summary(rows.select("query_id", "mode", F.col("rank_text").alias("rank")), "query_id")


def tool_trace(routed: DataFrame, queries: DataFrame, bases: list[KnowledgeBase], k: int = 5, mode: str = "hybrid_rerank") -> DataFrame:
    """(request_id, step_no, server, tool, args, num_results, results) of a search in every product that a request is
    routed to (query_id, product), in product order. The mode is pinned for every search tool alike."""
    found = [
        b.search(queries.join(routed.where(F.col("product") == b.product).select("query_id"), "query_id", "left_semi"), k, mode).select("query_id", "rank", "score", "section_path", "source_url", "text", F.lit(b.product).alias("server"))
        for b in bases
    ]
    hits = summarize_results(reduce(DataFrame.unionByName, found))
    shown = F.array_sort(F.collect_list(F.struct("rank", "section_path", "source_url", "score", "snippet")))
    steps = hits.groupBy("query_id", "server").agg(F.count("*").alias("num_results"), shown.alias("results"))
    every = routed.select("query_id", F.col("product").alias("server")).join(queries.select("query_id", "query"), "query_id").join(steps, ["query_id", "server"], "left")
    at = F.array_position(F.array_sort(F.array(*(F.lit(b.product) for b in bases))), F.col("server"))
    return every.select(
        F.col("query_id").alias("request_id"), at.alias("step_no"), "server", F.concat(F.col("server"), F.lit("_search_docs")).alias("tool"),
        F.create_map(F.lit("query"), F.col("query"), F.lit("mode"), F.lit(mode)).alias("args"), F.coalesce("num_results", F.lit(0)).alias("num_results"), "results",
    )
