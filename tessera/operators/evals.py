"""Evaluation: ranks, recall, MRR, pooled relevance, routing, judge means, latency, cost."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.config import PRICES
from tessera.functions.text import grade, loose_json, mentions, score, snippet
from tessera.schema import JUDGMENT


def first_match(results: DataFrame, haystack: Column, keywords: Column, unit: list[str]) -> DataFrame:
    """(unit, rank): the first rank whose text mentions a keyword; null if none does."""
    return results.groupBy(*unit).agg(F.min(F.when(mentions(haystack, keywords), F.col("rank"))).alias("rank"))


def hit_rates(ranks: DataFrame, by: list[str], ks: tuple[int, ...] = (1, 3, 5, 10), rank: str = "rank") -> DataFrame:
    """n, recall@k (hit rates) and mrr; a missing rank is a miss and counts 0."""
    hits = [F.avg(F.coalesce((F.col(rank) <= k).cast("double"), F.lit(0.0))).alias(f"recall_{k}") for k in ks]
    return ranks.groupBy(*by).agg(F.count("*").alias("n"), *hits, F.avg(F.coalesce(1.0 / F.col(rank), F.lit(0.0))).alias("mrr"))


def by_bar(category: Column, text_rank: Column, section_rank: Column) -> Column:
    """The rank that a category is judged by: exact terms by text, all others by section."""
    return F.when(category == "exact_term", text_rank).otherwise(section_rank)


def overall_and_by(df: DataFrame, mode: str, category: str, aggs: list[Column]) -> DataFrame:
    """Summaries by mode, over all categories (null) and by each, in one pass."""
    return df.groupingSets([[F.col(mode)], [F.col(mode), F.col(category)]], mode, category).agg(*aggs)


def oov_summary(ranks: DataFrame, unit: str = "query", mode: str = "mode") -> DataFrame:
    """vector_misses, keyword_rescues and rerank_rescues over queries of rare tokens."""
    wide = ranks.groupBy(unit).pivot(mode, ["keyword_only", "vector_only", "hybrid_rerank"]).agg(F.min("rank"))
    miss = F.col("vector_only").isNull()
    return wide.agg(F.count_if(miss).alias("vector_misses"), F.count_if(miss & F.col("keyword_only").isNotNull()).alias("keyword_rescues"), F.count_if(miss & F.col("hybrid_rerank").isNotNull()).alias("rerank_rescues"))


def pool(results: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Distinct hits of all modes of a query: what is to be judged."""
    return results.select("query_id", key).distinct()


def pooled_eval(results: DataFrame, qrels: DataFrame, k: int = 10, gold: int = 2, key: str = "chunk_id", mode: str = "mode", modes: Sequence[str] | None = None) -> DataFrame:
    """Per judged query and mode: set_recall (null if no grade reaches gold), ndcg (linear gain, ideal of the judged pool), gold_n and pool_n.

    A mode without a hit for a query has 0 there, in both. modes: by default those that stand in the results at all.
    """
    if modes is None:
        modes = sorted(r[0] for r in results.select(mode).distinct().collect())  # a handful
    rated = results.where(F.col("rank") <= k).join(qrels, ["query_id", key], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))
    gain = lambda g, r: F.sum(g / F.log2(r + 1.0))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("grade"), key))
    ideal = qrels.withColumn("r", rank).groupBy("query_id").agg(
        gain(F.when(F.col("r") <= k, F.col("grade")), F.col("r")).alias("idcg"), F.count_if(F.col("grade") >= gold).alias("gold_n"), F.count("*").alias("pool_n")
    )
    got = rated.groupBy("query_id", mode).agg(gain(F.col("grade"), F.col("rank")).alias("dcg"), F.count_if(F.col("grade") >= gold).alias("found"))
    every = ideal.withColumn(mode, F.explode(F.array(*map(F.lit, modes)).cast("array<string>")))
    both = every.join(got, ["query_id", mode], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("found", "dcg")})
    return both.select("query_id", mode, F.when(F.col("gold_n") > 0, F.col("found") / F.col("gold_n")).alias("set_recall"), F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0).alias("ndcg"), "gold_n", "pool_n")


def pooled_summary(units: DataFrame, mode: str = "mode") -> DataFrame:
    """set_recall over units with gold (their number is n), ndcg over all units."""
    return units.groupBy(mode).agg(F.count("set_recall").alias("n"), F.avg("set_recall").alias("set_recall"), F.avg("ndcg").alias("ndcg"), F.avg("pool_n").alias("pool"), F.avg("gold_n").alias("gold"))


def percentile_rank(n: Column, p: float) -> Column:
    """1-based place of a percentile among n sorted values: p * n / 100 rounded half to even, within 1..n."""
    return F.least(n, F.greatest(F.bround(F.lit(p / 100) * n).cast("long"), F.lit(1)))


def percentiles(df: DataFrame, by: str, value: str, ps: tuple[float, ...] = (50, 95)) -> DataFrame:
    """The values at the places of percentile_rank. Ranks come from counts of distinct values, not of rows, so that
    a group's rows are summed before they are exchanged."""
    counts = df.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("c"))
    w = W.partitionBy(by)
    run = counts.withColumn("upto", F.sum("c").over(w.orderBy(value))).withColumn("n", F.sum("c").over(w))
    return run.groupBy(by).agg(F.max("n").alias("n"), *(F.min(F.when(F.col("upto") >= percentile_rank(F.col("n"), p), F.col(value))).alias(f"p{p:g}") for p in ps))


def routing_correct(expected: Column, called: Column) -> Column:
    """Whether the two sets of products are equal: an extra one is a miss."""
    return F.array_sort(F.array_distinct(expected)) == F.array_sort(F.array_distinct(called))


AXES = ("correctness", "groundedness", "citation_quality")


def parse_judgment(text: Column, top: int = 5) -> Column:
    """Scores 0..top and rationale of a judge's answer; zeros if it can't be read."""
    j = F.from_json(loose_json(text), JUDGMENT)
    return F.struct(*(score(j[a], top).alias(a) for a in AXES), F.coalesce(j["rationale"], F.lit("")).alias("rationale"))


#: The labels of a judge's prompt and how many chunks it shows.
PROMPT, NO_CHUNKS, PROMPT_CHUNKS = "QUESTION:\n{}\n\nANSWER TO EVALUATE:\n{}\n\nRETRIEVED CHUNKS (the answer should be grounded in these):\n{}", "(no chunks retrieved)", 8


def judge_prompts(rows: DataFrame, chunks: DataFrame, key: str = "query_id") -> DataFrame:
    """(key, prompt) of answers (key, question, answer): what a judge is asked, with the whole texts of the first chunks
    (key, rank, score, section_path, text), each under its score and path."""
    line = F.concat(F.lit("- ["), F.col("score").cast("string"), F.lit("] "), F.array_join(F.coalesce("section_path", F.array().cast("array<string>")), " > "), F.lit(": "), F.coalesce("text", F.lit("")))
    shown = chunks.where(F.col("rank") <= PROMPT_CHUNKS).groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))
    parts = PROMPT.split("{}")
    filled = [F.coalesce("question", F.lit("")), F.coalesce("answer", F.lit("")), F.coalesce("lines", F.lit(NO_CHUNKS))]
    return rows.join(shown, key, "left").select(key, F.concat(F.lit(parts[0]), *(c for pair in zip(filled, map(F.lit, parts[1:]), strict=True) for c in pair)).alias("prompt"))


def pool_prompts(units: DataFrame, passages: DataFrame, key: str = "query_id", size: int = 500) -> DataFrame:
    """(key, prompt) of queries (key, product, query): the query and its pooled passages (key, no, section_path, text), numbered
    from 1, their white space folded and `size` characters of each."""
    text = F.substring(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)[\s\x1C-\x1F]+", " ")), 1, size)
    line = F.concat(F.col("no").cast("string"), F.lit(". ["), F.array_join(F.coalesce("section_path", F.array().cast("array<string>")), " > "), F.lit("] "), text)
    shown = passages.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))
    return units.join(shown, key, "left").select(key, F.concat(F.lit("QUERY (about "), F.upper("product"), F.lit("):\n"), "query", F.lit("\n\nPASSAGES:\n"), F.coalesce("lines", F.lit(""))).alias("prompt"))


def align_judgments(rows: DataFrame, judged: DataFrame, key: str = "custom_id") -> DataFrame:
    """Every row with its judgment; all zero where the batch has none."""
    out = rows.join(judged.select(key, *AXES), key, "left")
    return out.na.fill(0, list(AXES))


def judge_means(df: DataFrame, by: str) -> DataFrame:
    """Means of each axis without zeros, and quality: the mean of those that are above zero."""
    means = df.groupBy(by).agg(F.count("*").alias("n"), *(F.coalesce(F.avg(F.nullif(F.col(a), F.lit(0))), F.lit(0.0)).alias(a) for a in AXES))
    good = F.filter(F.array(*AXES), lambda x: x > 0)
    mean = F.aggregate(good, F.lit(0.0), lambda s, x: s + x) / F.size(good)
    return means.withColumn("quality", F.when(F.size(good) > 0, mean).otherwise(0.0))


def graded(df: DataFrame, column: str, top: int = 3) -> DataFrame:
    return df.withColumn("grade", grade(F.col(column), top))


def cost_usd(tokens_in: Column, out: Column, cache_write: Column, cache_read: Column) -> Column:
    total = PRICES["input"] * tokens_in + PRICES["output"] * out + PRICES["cache_write"] * cache_write + PRICES["cache_read"] * cache_read
    return F.round(total / 1e6, 6)


def cache_hit_ratio(read: Column, tokens_in: Column, write: Column) -> Column:
    """Share of the input that was read from the cache; 0 without input."""
    return F.coalesce(F.try_divide(read, read + tokens_in + write), F.lit(0.0))


def search_hits(trace: DataFrame) -> DataFrame:
    """The results of search tools in a trace (tool, results: array of structs with snippet), one row for each."""
    rows = trace.where(F.col("tool").startswith("search") & F.col("results").isNotNull()).select("*", F.explode("results").alias("hit"))
    return rows.where(F.col("hit.snippet").isNotNull()).drop("results")


def summarize_results(results: DataFrame, n: int = 8) -> DataFrame:
    """A trace's view of results (query_id, rank, score, text): the first n, score to three places, 200 characters."""
    return results.where(F.col("rank") <= n).withColumn("score", F.round("score", 3)).withColumn("snippet", snippet(F.col("text"), 200)).drop("text")


def report(summary: DataFrame, title: str, order: list[str]) -> str:
    """A Markdown table of an aggregate (a handful of rows: modes times categories)."""
    rows = summary.orderBy(*order).collect()
    head = "| " + " | ".join(summary.columns) + " |\n|" + "---|" * len(summary.columns)
    cell = lambda x: f"{x:.3f}" if isinstance(x, float) else str(x)
    return f"## {title}\n\n{head}\n" + "\n".join("| " + " | ".join(map(cell, r)) + " |" for r in rows) + "\n"
