from pyspark.sql import functions as F

from tessera.operators.retrieve import KnowledgeBase, keyword_router, tool_registry
from tessera.plans import evaluation as ev
from tessera.schema import QUESTION
from tessera.sources.fetch import fetch_urls


def world(spark):
    rows = [("c1", "erp", "gl", 0, "reversing a journal entry", ["General Ledger", "Journals"]), ("c2", "erp", "ap", 0, "accounts payable invoices", ["Payables"]), ("c3", "oci", "vm", 0, "compute instance shapes", ["Compute"]), ("c4", "oci", "net", 0, "virtual network rules", ["Network"])]
    chunks = spark.createDataFrame([(a, b, c, d, e, f, "u") for a, b, c, d, e, f in rows], "chunk_id string, product string, doc_id string, chunk_index int, text string, section_path array<string>, source_url string")
    vec = {"c1": [1.0, 0.0], "c2": [0.0, 1.0], "c3": [1.0, 1.0], "c4": [-1.0, 0.0]}
    vectors = spark.createDataFrame([(r[0], r[1], r[2], vec[r[0]]) for r in rows], "chunk_id string, product string, doc_id string, embedding array<float>")
    return chunks, vectors


def test_retrieval_eval_and_scorecard(spark):
    chunks, vectors = world(spark)
    q = spark.createDataFrame([("q1", "reverse journal entry", ["erp"], ["journals"], "", None), ("q2", "journal and compute", ["erp", "oci"], ["compute"], "", None), ("x1", "zzz payable", ["erp"], ["payable"], "", "exact_term")], QUESTION)
    units = ev.units(q, spark.createDataFrame([("q1", [1.0, 0.0]), ("q2", [1.0, 0.1]), ("x1", [0.0, 1.0])], "id string, q_vec array<float>"))
    rows = ev.retrieval_eval(units, chunks, vectors, ["erp", "oci"]).cache()
    assert rows.count() == 16
    got = {(r.query_id, r.mode): (r.rank_text, r.rank_section) for r in rows.collect()}
    assert got["q1|erp", "keyword_only"] == (1, 1) and got["q2|oci", "vector_only"] == (1, 1) and got["q2|erp", "keyword_only"] == (None, None)
    text = ev.scorecard(rows)
    assert "## text bar" in text and "exact_term" in text and "hybrid_fusion=adaptive" in text
    probes = spark.createDataFrame([("payable", "erp", "payable", [1.0, 0.0])], "query string, product string, token string, q_vec array<float>")
    assert tuple(ev.oov_eval(probes, chunks, vectors, ["erp"], 1).first()) == (1, 1, 1)


def test_routed_traces(spark):
    chunks, vectors = world(spark)
    bases = [KnowledgeBase(chunks, vectors, p, {"ledger": ["gl"]}) for p in ("erp", "oci")]
    q = spark.createDataFrame([(1, "payable invoices", [0.0, 1.0]), (2, "compute shapes", [1.0, 1.0])], "query_id long, query string, q_vec array<float>")
    routed = keyword_router(q, {"erp": ["payable"], "oci": ["compute"]})
    steps = {(r.request_id, r.server): r for r in ev.tool_trace(routed, q, bases).collect()}
    assert set(steps) == {(1, "erp"), (2, "oci")} and steps[1, "erp"].tool == "erp_search_docs" and steps[1, "erp"].results[0].snippet == "accounts payable invoices"
    assert {r.tool for r in tool_registry(bases).collect()} >= {"erp_search_ledger", "oci_list_topics"}
    assert {r.doc_id for r in bases[0].search(q, 5, "vector_only", "ledger").collect()} == {"gl"}
    assert bases[0].get_document("gl").first().full_text == "reversing a journal entry" and bases[1].list_topics().count() == 2


def test_failed_fetches_are_rows(spark):
    def get(url):
        if "bad" in url:
            raise OSError("no")
        return url.encode()

    want = spark.createDataFrame([("p", "a", "u/a"), ("p", "b", "u/bad"), ("p", "c", "u/c"), ("q", "a", "u/d")], "product string, doc_id string, url string")
    have = spark.createDataFrame([("q", "a", bytearray(b"x")), ("p", "a", bytearray(b""))], "product string, doc_id string, content binary")
    got = {(r["product"], r.doc_id): (bytes(r.content) if r.content else None, r.error) for r in fetch_urls(want, get, have, 2).collect()}
    assert got == {("p", "a"): (b"u/a", None), ("p", "b"): (None, "OSError: no")}
    assert fetch_urls(want, get, have, force=True).where(F.col("error").isNull()).count() == 3
