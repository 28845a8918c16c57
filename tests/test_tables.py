"""Table functions, whole chunk rows, tables made once, and measured runs."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions.tables import packed, register_tables
from tessera.operators.chunking import chunk_text, html_blocks, pack_chunks
from tessera.operators.retrieve import KnowledgeBase, product_rows, retrieve
from tessera.plans.evaluation import measured_runs, run_summary
from tessera.schema import CHUNK, create_if_absent

from .test_plans import world


def test_table_functions_equal_the_folds(spark):
    rng = random.Random(6)
    rows = []
    for d in range(30):
        for b in range(rng.randrange(12)):
            text = " ".join(rng.choice(["one", "two.", "three!", "four", "  "]) for _ in range(rng.choice([0, 3, 20, 60, 130])))
            rows.append((d, b, [f"h{rng.randrange(2)}", f"s{rng.randrange(3)}"][: rng.randrange(3)], text))
    rng.shuffle(rows)
    blocks = spark.createDataFrame(rows, "doc_id long, block_no int, section_path array<string>, text string").repartition(3)
    for least, most in ((20, 50), (1, 1), (400, 800)):
        want = sorted(map(str, pack_chunks(blocks, "doc_id", least, most).select("doc_id", "chunk_index", "section_path", "text").collect()))
        assert sorted(map(str, packed(blocks, "doc_id", least, most).collect())) == want
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    pages.union(spark.createDataFrame([(-1, "u", None), (-2, "u", "<![x[")], pages.schema)).createOrReplaceTempView("some_pages")
    register_tables(spark)
    got = spark.sql("SELECT page_id, b.* FROM some_pages, LATERAL html_blocks(html) b")
    assert sorted(map(str, got.collect())) == sorted(map(str, html_blocks(spark.table("some_pages"), "page_id").collect())) and got.count() > 50


def test_front_doors_give_whole_rows(spark):
    docs = spark.createDataFrame([("a", "erp", "https://x", "# H\none"), ("b", "oci", None, "two")], "doc_id string, product string, source_url string, text string")
    rows = chunk_text(docs)
    assert {c.split()[0] for c in CHUNK.split(", ")} == set(rows.columns)
    assert {(r.doc_id, r["product"], r.source_url, r.text) for r in rows.collect()} == {("a", "erp", "https://x", "one"), ("b", "oci", None, "two")}


def test_tables_are_made_once(spark, tmp_path):
    path = str(tmp_path / "t")
    assert create_if_absent(spark, path, CHUNK).count() == 0
    spark.createDataFrame([("i", "erp", "d", 0, "t", [], "u")], CHUNK).write.mode("append").parquet(path)
    assert create_if_absent(spark, path, CHUNK).count() == 1
    with pytest.raises(ValueError, match="has the columns"):
        create_if_absent(spark, path, "id long")


def test_runs_are_measured_and_fail_alone(spark):
    chunks, vectors = world(spark)
    q = spark.createDataFrame([(1, "payable invoices", [0.0, 1.0]), (2, "zzz", [1.0, 1.0])], "query_id long, query string, q_vec array<float>")
    runs = {m: lambda m=m: retrieve(chunks, vectors, q, m, 3) for m in ("keyword_only", "vector_only")} | {"broken": lambda: q.select("query_id", F.raise_error(F.lit("no service")).cast("double").alias("score")), "unplanned": lambda: q.select("nothing")}
    rows = {(r.query_id, r.run): r for r in measured_runs(q, runs).collect()}
    assert len(rows) == 8 and rows[1, "keyword_only"].hits == 1 and rows[2, "keyword_only"].hits == 0 and rows[2, "vector_only"].hits == 3
    assert all(r.error and r.hits == 0 for (_, run), r in rows.items() if run in ("broken", "unplanned")) and rows[1, "vector_only"].error is None
    got = {r.run: r for r in run_summary(measured_runs(q, runs)).collect()}
    assert (got["keyword_only"].with_hits, got["broken"].failed, got["keyword_only"].failed) == (1, 2, 0) and all(r.ms > 0 for r in got.values())


def test_product_rows(spark):
    chunks, vectors = world(spark)
    rows = product_rows([KnowledgeBase(chunks, vectors, "erp", {"ledger": ["gl"]}), KnowledgeBase(chunks, vectors, "oci")], {"erp": 8001}).collect()
    assert {(r["product"], r.port, r.tool, tuple(r.doc_ids)) for r in rows} >= {("erp", 8001, "erp_search_ledger", ("gl",)), ("erp", 8001, "erp_search_docs", ()), ("oci", None, "oci_list_topics", ())}
