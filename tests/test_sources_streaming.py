import json

from pyspark.sql import functions as F

from tessera.functions.seams import embed_with, hash_embedding, with_retry
from tessera.operators.chunking import chunk_text
from tessera.sources import fetch
from tessera.streaming.bucket_store import BucketStore
from tessera.streaming.ingest import reduce_events, stream_ingest, windowed_counts


def test_manifest_records_and_dataset(spark, tmp_path):
    manifest = {"products": {"erp": {"label": "E", "collection": "c", "fetch_mode": "pdf", "documents": [{"doc_id": "d", "title": "t", "url": "u"}]}, "oci": {"label": "O", "collection": "o", "fetch_mode": "html", "services": [{"name": "s", "seed_url": "x", "path_prefix": "p"}], "crawl": {"host_prefix": "h", "max_pages_per_service": 3}}}}
    (tmp_path / "m.json").write_text(json.dumps(manifest, indent=1))
    m = fetch.read_manifest(spark, str(tmp_path / "m.json"))
    assert {r["product"] for r in m.collect()} == {"erp", "oci"}
    assert fetch.manifest_documents(m).first().doc_id == "d" and fetch.manifest_services(m).first().seed_url == "x"
    assert fetch.read_records(spark, str(tmp_path / "none.json")).count() == 0
    lines = [{"id": "a", "question": "q", "expected_products": ["x", "y"]}, {"id": "adv-1", "question": "q", "expected_products": ["x"]}, {"id": "b", "question": "q", "expected_products": ["x"], "tag": "exact_term"}]
    (tmp_path / "q.jsonl").write_text("\n\n".join(map(json.dumps, lines)))
    q = fetch.read_dataset(spark, str(tmp_path / "q.jsonl"))
    assert q.count() == 3 and fetch.semantic_units(q).count() == 2 and fetch.expand_modes(fetch.semantic_units(q), ["m", "n"]).count() == 4
    assert [r.id for r in fetch.select_questions(q, ids=["b", "a"], limit=1).collect()] == ["a"]
    fetch.write_jsonl(q, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 3


def test_crawl_is_bounded_and_ordered(spark):
    page = lambda u, *links: (u, "<p>x</p>" + "".join(f'<a href="{x}">n</a>' for x in links))
    rows = [page("https://h/s/a.html", "b.html", "c.html#f", "/t/out.html", "b.pdf"), page("https://h/s/b.html", "a.html", "d.html"), page("https://h/s/c.html", "e.html"), page("https://h/s/d.html"), page("https://h/s/e.html")]
    pages = spark.createDataFrame(rows, "url string, html string")
    got = fetch.crawl(pages, "https://h/s/a.html", "https://h/", "https://h/s/", 4, "/s/").orderBy("place").collect()
    assert [r.doc_id for r in got] == ["a", "b", "c", "d"]
    assert fetch.crawl(pages, "https://h/s/none.html", "https://h/", "https://h/s/", 4).count() == 0


def test_collect_chunks_by_format_and_limit(spark):
    rows = [("p", "d1", "u", "html", "<h1>A</h1><p>x</p>"), ("p", "d2", "u", "md", "# B\ny"), ("p", "d3", "u", "html", "<p>z</p>"), ("q", "d1", "u", "exe", "zz"), ("q", "d2", "u", "html", None)]
    df = spark.createDataFrame(rows, "product string, doc_id string, source_url string, format string, content string")
    assert {(r.doc_id, r.text) for r in fetch.collect_chunks(df, 2).collect()} == {("d1", "x"), ("d2", "y")}


def test_incremental_ingest_is_idempotent(spark, tmp_path):
    src, schema = str(tmp_path / "src"), "doc_id string, text string"
    out = "doc_id string, chunk_index int, section_path array<string>, text string, id string"
    store = BucketStore(spark, "file://" + str(tmp_path / "store"), out, group="doc_id", buckets=16)
    assert store.read().count() == 0
    spark.createDataFrame([("a", "# H\none"), ("b", "two")], schema).write.parquet(src + "/1")
    run = lambda cp: stream_ingest(spark, src, schema, chunk_text, store, str(tmp_path / cp)).awaitTermination()
    run("cp")
    first = sorted(map(tuple, store.read().select("id", "text").collect()))
    run("cp2")  # everything again
    assert sorted(map(tuple, store.read().select("id", "text").collect())) == first and len(first) == 2
    spark.createDataFrame([("a", "# H\nchanged")], schema).write.parquet(src + "/2")
    run("cp")
    assert {r.text for r in store.read().collect()} == {"changed", "two"}


def test_event_reduction_and_windows(spark):
    rows = [(1, 2, "answer_delta", "b"), (1, 1, "answer_delta", "a"), (1, 0, "tool_call", "t"), (1, 3, "done", ""), (2, 0, "answer_delta", "x")]
    got = {r.request_id: (r.answer, r.steps, r.done) for r in reduce_events(spark.createDataFrame(rows, "request_id long, seq long, type string, payload string")).collect()}
    assert got == {1: ("ab", ["t"], True), 2: ("x", [], False)}
    ev = spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 2.0), ("2024-01-01 01:00:00", "a", 4.0)], "ts string, event_type string, value double")
    assert sorted((r.n, r.total) for r in windowed_counts(ev).collect()) == [(1, 4.0), (2, 3.0)]


def test_seams(spark):
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise TimeoutError
        return "ok"

    assert with_retry(flaky, (TimeoutError,), sleep=lambda s: None) == "ok" and len(calls) == 3
    df = spark.createDataFrame([("journal entry",), ("",)], "text string")
    got = df.select(hash_embedding(F.col("text"), 8).alias("v")).collect()
    assert abs(sum(x * x for x in got[0].v) - 1) < 1e-6 and set(got[1].v) == {0.0}
    assert [len(r.embedding) for r in embed_with(df, "text", lambda ts: [[float(len(t)), 0.0] for t in ts], 2, batch=1).collect()] == [2, 2]
