"""The batch tool loop against a replay of one request at a time."""

from pyspark.sql import functions as F

from tessera.operators.retrieve import KnowledgeBase
from tessera.plans.loop import loop_usage, tool_loop, widening_router

from .test_plans import world

PRODUCTS = {"erp": ["payable", "journal"], "oci": ["compute"]}
QUERIES = [(1, "payable invoices", [0.0, 1.0]), (2, "compute and journal", [1.0, 1.0]), (3, "journal of nothing", None), (4, "zzz", None), (5, "virtual network payable", None)]


def replay(spark, bases, qid, query, vec, mode, max_steps=8):
    """Steps as (step, call_no, server, tool, number of results, error), and how it stopped."""
    trace, asked, best, read = [], set(), None, False
    q = spark.createDataFrame([(0, query, vec)], "query_id long, query string, q_vec array<float>")
    for step in range(max_steps):
        if step == 0:
            hit = [p for p in sorted(PRODUCTS) if any(w in query.lower() for w in PRODUCTS[p])] or sorted(PRODUCTS)
            calls = [(p, "search_docs") for p in hit]
        elif read:
            calls = []
        elif best:
            calls = [(best[2], "get_document")]
        else:
            calls = [(p, "search_docs") for p in sorted(PRODUCTS)] if len(asked) < len(PRODUCTS) else []
        if not calls:
            return trace, "done"
        found = []
        for no, (p, tool) in enumerate(calls):
            if tool == "search_docs":
                rows = bases[p].search(q, 5, mode).orderBy("rank").collect()
                asked.add(p)
                if rows:
                    found.append((-round(rows[0].score, 3), no, p, rows[0].doc_id))
                trace.append((step, no, p, f"{p}_search_docs", len(rows), None))
            else:
                read = True
                trace.append((step, no, p, f"{p}_get_document", 1, None))
        best = min(found) if found else best
    return trace, "max_steps"


def test_loop_equals_replay(spark):
    chunks, vectors = world(spark)
    bases = {p: KnowledgeBase(chunks, vectors, p) for p in ("erp", "oci")}
    requests = spark.createDataFrame(QUERIES, "request_id long, query string, q_vec array<float>")
    trace, state = tool_loop(requests, list(bases.values()), widening_router(PRODUCTS), "keyword_only")
    rows = trace.collect()
    for qid, query, vec in QUERIES:
        want, stop = replay(spark, bases, qid, query, vec, "keyword_only")
        got = sorted((r.step, r.call_no, r.server, r.tool, r.num_results, r.error) for r in rows if r.request_id == qid)
        assert got == want, qid
    assert {r.request_id: r.stop for r in state.collect()} == {q[0]: "done" for q in QUERIES}
    assert all(len(r.results) == r.num_results for r in rows)
    assert [r.upto for r in loop_usage(trace).where("request_id = 1").orderBy("step").collect()] == [1, 2]


def test_failed_calls_are_rows_and_steps_end(spark):
    chunks, vectors = world(spark)
    base = KnowledgeBase(chunks, vectors, "erp", {"ledger": ["gl"]})
    requests = spark.createDataFrame(QUERIES[:2], "request_id long, query string, q_vec array<float>")
    tools = ["erp_nothing", "erp_get_document", "erp_search_ledger", "erp_list_topics"]

    def stubborn(open_, step):
        args = F.create_map(F.lit("query"), F.lit("journal payable"), F.lit("doc_id"), F.lit("none"))
        return open_.select("request_id", F.posexplode(F.array(*map(F.lit, tools))).alias("call_no", "tool")).withColumn("args", args)

    trace, state = tool_loop(requests, [base], stubborn, "keyword_only", max_steps=2)
    rows = {(r.request_id, r.step, r.call_no): r for r in trace.collect()}
    assert len(rows) == 2 * 2 * 4
    for step in (0, 1):
        assert rows[1, step, 0].error == "no tool erp_nothing" and rows[1, step, 1].error == "no document none"
        assert [x.doc_id for x in rows[1, step, 2].results] == ["gl"] and rows[1, step, 3].num_results == 2
    assert {(r.steps, r.stop) for r in state.collect()} == {(2, "max_steps")}
    none, left = tool_loop(requests.limit(0), [base], stubborn, "keyword_only")
    assert none.count() == 0 and left.count() == 0
