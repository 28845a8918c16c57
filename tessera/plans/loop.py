"""The tool loop over a batch of requests: each step routes all open requests at once, runs their calls and records them.

The state is a table of requests with what they have found so far. A router (a seam: a model, or the deterministic
default) gives the calls of a step; a request without calls stops. Calls meet the registry of tools in a join, each tool
runs once a step over all its calls, and what fails is a row with its error, not the end of the batch.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.retrieve import KnowledgeBase, tool_registry
from tessera.session import discard, materialize

MAX_STEPS = 8
#: What a trace shows of a result, and how many of them.
SHOWN, RESULT = 8, "array<struct<rank:int,section_path:array<string>,source_url:string,score:double,snippet:string,doc_id:string>>"
CALL = "request_id, call_no, tool, args"
#: Requests (request_id, query, q_vec) with the steps taken and the calls and results of the last one, to (request_id, call_no, tool, args).
Router = Callable[[DataFrame, int], DataFrame]


def widening_router(products: dict[str, list[str]]) -> Router:
    """The deterministic stand-in for a model's choice of tools.

    First a search in every product whose keywords stand in the query (in all, if none does); then, if nothing was found
    and not all products were asked, a search in all; then the best hit's whole document; then nothing.
    """
    low, every = F.lower(F.col("query")), F.array(*(F.lit(p) for p in sorted(products)))
    named = F.filter(F.array(*(F.when(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w)), F.lit(p)) for p, words in sorted(products.items()))), lambda p: p.isNotNull())
    search = lambda ps: F.transform(ps, lambda p: F.struct(F.concat(p, F.lit("_search_docs")).alias("tool"), F.create_map(F.lit("query"), F.col("query")).alias("args")))

    def route(open_: DataFrame, step: int) -> DataFrame:
        none = F.filter(search(every), lambda c: F.lit(False))
        if step == 0:
            calls = search(F.when(F.size(named) > 0, named).otherwise(every))
        else:
            best = F.col("best")
            document = F.array(F.struct(F.concat(best["server"], F.lit("_get_document")).alias("tool"), F.create_map(F.lit("doc_id"), best["doc_id"]).alias("args")))
            asked_all = F.size(F.col("asked")) >= len(products)
            calls = F.when(F.col("read"), none).when(best.isNotNull(), document).when(~asked_all, search(every)).otherwise(none)
        return open_.select("request_id", F.posexplode(calls).alias("call_no", "call")).select("request_id", "call_no", "call.tool", "call.args")

    return route


def _searched(base: KnowledgeBase, calls: DataFrame, mode: str, k: int, scope: str | None = None) -> DataFrame:
    """(request_id, call_no, results, num_results, error) of a product's searches, in a module's documents if one is named."""
    asked = calls.withColumn("query_id", F.concat_ws("|", "request_id", "call_no"))
    found = base.search(asked.select("query_id", F.col("args")["query"].alias("query"), "q_vec"), k, mode, scope)
    shown = F.struct("rank", "section_path", "source_url", F.round("score", 3).alias("score"), F.substring(F.regexp_replace("text", r"(?U)\s+", " "), 1, 200).alias("snippet"), "doc_id")
    lists = found.groupBy("query_id").agg(F.count("*").alias("num_results"), F.slice(F.array_sort(F.collect_list(shown)), 1, SHOWN).cast(RESULT).alias("results"))
    return asked.join(lists, "query_id", "left").select("request_id", "call_no", F.coalesce("results", F.array().cast(RESULT)).alias("results"), F.coalesce("num_results", F.lit(0)).alias("num_results"), F.lit(None).cast("string").alias("error"))


def _documents(base: KnowledgeBase, calls: DataFrame) -> DataFrame:
    """The same of a product's whole documents: one result, or an error if there is none of that id."""
    mine = base.chunks.where(F.col("product") == base.product)
    first = mine.groupBy("doc_id").agg(F.min_by(F.struct("section_path", "source_url", "text"), "chunk_index").alias("c"))
    met = calls.withColumn("doc_id", F.col("args")["doc_id"]).join(first, "doc_id", "left")
    shown = F.struct(F.lit(1).alias("rank"), F.col("c.section_path"), F.col("c.source_url"), F.lit(None).cast("double").alias("score"), F.substring(F.regexp_replace("c.text", r"(?U)\s+", " "), 1, 200).alias("snippet"), "doc_id")
    got = F.col("c").isNotNull()
    return met.select("request_id", "call_no", F.when(got, F.array(shown)).otherwise(F.array()).cast(RESULT).alias("results"), got.cast("int").cast("long").alias("num_results"), F.when(~got, F.concat(F.lit("no document "), F.coalesce("doc_id", F.lit("null")))).alias("error"))


def _topics(base: KnowledgeBase, calls: DataFrame) -> DataFrame:
    n = base.list_topics().agg(F.count("*").alias("num_results")).withColumn("product", F.lit(base.product))
    return calls.join(F.broadcast(n), "product").select("request_id", "call_no", F.array().cast(RESULT).alias("results"), "num_results", F.lit(None).cast("string").alias("error"))  # one row


def tool_loop(requests: DataFrame, bases: list[KnowledgeBase], router: Router, mode: str = "hybrid_rerank", k: int = 5, max_steps: int = MAX_STEPS) -> tuple[DataFrame, DataFrame]:
    """The trace and the state of requests (request_id, query, q_vec) after at most `max_steps` steps.

    Trace: request_id, step, call_no, server, tool, args, num_results, results, error, one row a call. State: request_id,
    steps, best (server and doc_id of the best hit so far), asked (products searched), read (a document was read) and
    stop: `done` if the router had no more calls, else `max_steps`. The mode is pinned for every search. A tool that
    is not in the registry, or a document that is not there, gives an error row, which ends no request.
    """
    registry = F.broadcast(tool_registry(bases))  # a few tools a product
    kept = "request_id, steps, best, asked, read".split(", ")
    open_ = materialize(
        requests.select("request_id", "query", "q_vec", F.lit(0).alias("steps"), F.lit(None).cast("struct<server: string, doc_id: string>").alias("best"), F.array().cast("array<string>").alias("asked"), F.lit(False).alias("read")), "open"
    )
    traces, stopped = [], []
    for step in range(max_steps):
        calls = materialize(router(open_, step).join(registry, "tool", "left"), "calls")
        going = calls.select("request_id").distinct()
        stopped.append(materialize(open_.join(going, "request_id", "left_anti").select(*kept, F.lit("done").alias("stop")), "stopped"))
        if not calls.limit(1).count():
            break
        asked = calls.join(open_.select("request_id", "q_vec"), "request_id")
        parts = [calls.where("product IS NULL").select("request_id", "call_no", F.array().cast(RESULT).alias("results"), F.lit(0).cast("long").alias("num_results"), F.concat(F.lit("no tool "), "tool").alias("error"))]
        for b in bases:
            mine = asked.where(F.col("product") == b.product)
            parts += [_searched(b, mine.where("original = 'search_docs'"), mode, k), _documents(b, mine.where("original = 'get_document'")), _topics(b, mine.where("original = 'list_topics'"))]
            parts += [_searched(b, mine.where(F.col("original") == f"search_{s}"), mode, k, s) for s in b.scopes]
        results = reduce(DataFrame.unionByName, parts)
        trace = calls.join(results, ["request_id", "call_no"], "left").select("request_id", F.lit(step).alias("step"), "call_no", F.col("product").alias("server"), "tool", "args", F.coalesce("num_results", F.lit(0)).alias("num_results"), F.coalesce("results", F.array().cast(RESULT)).alias("results"), F.coalesce("error", F.when(F.col("num_results").isNull(), F.concat(F.lit("no tool "), "tool"))).alias("error"))
        traces.append(materialize(trace, "trace"))
        searched = F.col("tool").contains("_search_")
        hit = F.when(searched & (F.col("num_results") > 0), F.struct(-F.get("results", F.lit(0))["score"], "call_no", F.struct("server", F.get("results", F.lit(0))["doc_id"].alias("doc_id")).alias("hit")))
        news = traces[-1].groupBy("request_id").agg(F.min(hit).alias("top"), F.collect_set(F.when(searched, F.col("server"))).alias("more"), F.max(F.col("tool").endswith("_get_document")).alias("got"))
        after = open_.join(news, "request_id").select(
            "request_id", "query", "q_vec", (F.col("steps") + 1).alias("steps"), F.coalesce("top.hit", "best").cast("struct<server: string, doc_id: string>").alias("best"), F.array_sort(F.array_union("asked", "more")).alias("asked"), (F.col("read") | F.col("got")).alias("read")
        )
        later = materialize(after, "open")
        discard(open_, calls)
        open_ = later
    else:
        stopped.append(open_.select(*kept, F.lit("max_steps").alias("stop")))
    none = requests.sparkSession.createDataFrame([], f"request_id {requests.schema['request_id'].dataType.simpleString()}, step int, call_no int, server string, tool string, args map<string,string>, num_results long, results {RESULT}, error string")
    return reduce(DataFrame.unionByName, traces, none), reduce(DataFrame.unionByName, stopped)


def loop_usage(trace: DataFrame) -> DataFrame:
    """(request_id, step, results, upto): results of each step and those of all steps so far, per request."""
    per = trace.groupBy("request_id", "step").agg(F.sum("num_results").alias("results"))
    return per.withColumn("upto", F.sum("results").over(W.partitionBy("request_id").orderBy("step")))
