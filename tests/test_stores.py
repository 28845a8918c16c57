"""Stored tables: vector collections and the bucketed upsert."""

import glob
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators.vector import cosine_search
from tessera.operators.vector_store import VectorStore
from tessera.streaming.bucket_store import BucketStore

CHUNKS = "chunk_id string, product string, doc_id string, chunk_index int, text string, section_path array<string>"
VECTORS = "chunk_id string, embedding array<float>"


def chunk_rows(spark, rows):
    return spark.createDataFrame(rows, CHUNKS)


def unit(i, dim=8):
    return [1.0 if j == i else 0.0 for j in range(dim)]


def smoke(spark, path, **k):
    payload = spark.createDataFrame([], CHUNKS).drop("product").schema
    return VectorStore.create(spark, path, 8, payload, **k)


def test_collections_as_a_user_drives_them(spark, tmp_path):
    """Made twice without harm, upserts without doubles, searches that stay in their product and documents, payload whole."""
    path = str(tmp_path / "v")
    store = smoke(spark, path)
    store = smoke(spark, path)
    chunks = chunk_rows(spark, [("c1", "erp", "erp-gl", 0, "reversing journal entry", ["General Ledger", "Journals"]), ("c2", "erp", "erp-gl", 1, "supplier invoices", None), ("c3", "oci", "oci-compute", 0, "compute", None)])
    vectors = spark.createDataFrame([("c1", unit(0)), ("c2", unit(1)), ("c3", unit(0))], VECTORS)
    for _ in range(2):
        store.upsert(chunks, vectors)
        assert (store.count("erp"), store.count("oci"), store.count("epm")) == (2, 1, 0)
    q = spark.createDataFrame([(0, unit(0))], "query_id long, q_vec array<float>")
    hits = store.search(q, 5, "erp").join(store.points("erp"), "chunk_id").orderBy("rank").collect()
    assert hits[0].chunk_index == 0 and hits[0].score > 0.99 and hits[0].section_path == ["General Ledger", "Journals"]
    assert {h.doc_id for h in hits} == {"erp-gl"}
    store.upsert(chunk_rows(spark, [("c4", "erp", "erp-ap", 0, "payables", None)]), spark.createDataFrame([("c4", unit(0))], VECTORS))
    assert [r.chunk_id for r in store.search(q, 10, "erp", ["erp-ap"]).collect()] == ["c4"]
    assert {"c1", "c2", "c4"} == {r.chunk_id for r in VectorStore.open(spark, path).search(q, 10, "erp").collect()}
    store.remove(spark.createDataFrame([("c1",), ("nothing",)], "chunk_id string"))
    assert {r.chunk_id for r in store.search(q, 10, "erp").collect()} == {"c2", "c4"}
    # A chunk moves to another product with its upsert.
    store.upsert(chunk_rows(spark, [("c2", "epm", "d", 0, "t", None)]), spark.createDataFrame([("c2", unit(3))], VECTORS))
    small = store.compact(str(tmp_path / "w"))
    for s in (store, small):
        assert (s.count("erp"), s.count("epm"), s.count("oci")) == (1, 1, 1)
    assert smoke(spark, path, recreate=True).count("erp") == 0


def test_wrong_vectors_write_nothing(spark, tmp_path):
    store = smoke(spark, str(tmp_path / "v"))
    one = chunk_rows(spark, [("c1", "erp", "d", 0, "t", None)])
    for vectors, chunks, message in (
        ([("c1", [1.0])], one, "vector length 1 is not 8"),
        ([("c1", unit(0)), ("c2", unit(0))], one, "differ in number"),
        ([], one, "differ in number"),
        ([("c1", unit(0))], one.withColumn("product", F.lit("other")), "no collection for product other"),
    ):
        with pytest.raises(ValueError, match=message):
            store.upsert(chunks, spark.createDataFrame(vectors, VECTORS))
        assert store.segments() == []
    with pytest.raises(ValueError, match="other collections"):
        VectorStore.create(spark, str(tmp_path / "v"), 4, store.payload)
    with pytest.raises(ValueError, match="query length 2 is not 8"):
        store.search(spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, q_vec array<float>"), 3)


def test_a_search_reads_its_product_and_lists(spark, tmp_path):
    """The plan names the product's partition, and with probes the lists; half-written segments are not seen."""
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(12, 8))
    rows = [(f"c{i:04d}", ("erp", "oci")[i % 2], f"d{i % 5}", i, "t", None) for i in range(600)]
    v = [(r[0], [float(x) for x in middles[i % 12] + 0.2 * rng.normal(size=8)]) for i, r in enumerate(rows)]
    store = smoke(spark, str(tmp_path / "v"))
    store.upsert(chunk_rows(spark, rows), spark.createDataFrame(v, VECTORS))
    trained = store.train(str(tmp_path / "t"), lists=12)
    q = spark.createDataFrame([(i, v[i * 7][1]) for i in range(20)], "query_id long, q_vec array<float>")
    assert 1 <= trained.probes < 12
    r = trained.recall(q, 10, product="erp").first()
    assert r.n == 20 and r.recall >= 0.9
    exact = sorted(map(tuple, trained.search(q, 10, "erp").collect()))
    assert exact == sorted(map(tuple, cosine_search(trained.points("erp"), q, 10).collect())) == sorted(map(tuple, store.search(q, 10, "erp").collect()))
    files = trained.points("erp").select(F.input_file_name().alias("f")).distinct().collect()
    assert files and all("product=erp" in x.f for x in files)
    few = trained.search(q.where("query_id = 0"), 10, "erp", probes=1)
    plan = few._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "erp" in plan and "list" in plan.split("PartitionFilters", 1)[1].split("\n")[0]
    assert few.count() == 10
    # New points go to the same lists and are found.
    trained.upsert(chunk_rows(spark, [("new", "erp", "d", 0, "t", None)]), spark.createDataFrame([("new", v[0][1])], VECTORS))
    assert "new" in {x.chunk_id for x in trained.search(q.where("query_id = 0"), 10, "erp", probes=1).collect()}
    os.makedirs(tmp_path / "t" / "points" / "seg=2" / "product=erp" / "list=0")
    assert VectorStore.open(spark, str(tmp_path / "t")).segments() == [0, 1]


def test_null_vectors_are_no_hits(spark):
    v = spark.createDataFrame([("a", unit(0)), ("b", None), ("c", [None] * 8)], VECTORS)
    q = spark.createDataFrame([(0, unit(0)), (1, None)], "query_id long, q_vec array<float>")
    assert [(r.query_id, r.chunk_id) for r in cosine_search(v, q, 5).collect()] == [(0, "a")]
    assert cosine_search(v, q.where("query_id = 1"), 5).count() == 0
    with pytest.raises(Exception, match="vector length is not 2"):
        cosine_search(v, spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, q_vec array<float>"), 5).collect()


def test_bucketed_upserts_write_what_they_meet(spark, tmp_path):
    schema = "doc_id string, id string, text string"
    store = BucketStore(spark, "file://" + str(tmp_path / "b"), schema, group="doc_id", buckets=64)
    assert store.read().count() == 0 and store.version() == -1
    rows = [(f"d{i % 400}", f"d{i % 400}:{i // 400}", f"text {i} " * 20) for i in range(2000)]
    store.merge(spark.createDataFrame(rows, schema))
    whole = store.written()
    state = {r[1]: r for r in rows}
    assert {r.id: tuple(r) for r in store.read().collect()} == state
    # One document: one bucket, and a small part of the bytes.
    store.merge(spark.createDataFrame([("d7", "d7:0", "changed"), ("d7", "d7:9", "new")], schema))
    state |= {"d7:0": ("d7", "d7:0", "changed"), "d7:9": ("d7", "d7:9", "new")}
    assert {r.id: tuple(r) for r in store.read().collect()} == state and store.written() * 20 < whole
    assert sorted(r.id for r in store.lookup(["d7", "none"]).collect()) == ["d7:0", "d7:1", "d7:2", "d7:3", "d7:4", "d7:9"]
    # The whole document is replaced; a replayed batch changes nothing.
    assert store.merge(spark.createDataFrame([("d7", "d7:0", "only")], schema), replace=True, stream="s", batch=4)
    assert not store.merge(spark.createDataFrame([("d7", "d7:5", "late")], schema), stream="s", batch=4)
    assert [tuple(r) for r in store.lookup(["d7"]).collect()] == [("d7", "d7:0", "only")]
    store.remove(spark.createDataFrame([("d7", "d7:0")], "doc_id string, id string"))
    assert store.lookup(["d7"]).count() == 0 and store.read().count() == 1995
    # Folders of versions that no manifest names are gone; what a lost writer left is not read and is overwritten.
    kept = {v for n in (store.version(), store.version() - 1) for v in store.manifest(n)["places"].values()}
    assert {int(p.rsplit("=", 1)[1]) for p in glob.glob(str(tmp_path / "b" / "data" / "v=*")) if glob.glob(p + "/bucket=*")} <= kept
    os.makedirs(tmp_path / "b" / "data" / f"v={store.version() + 1}" / "bucket=0")
    store.merge(spark.createDataFrame([], schema))
    assert store.read().count() == 1995
    with pytest.raises(ValueError, match="64 buckets"):
        BucketStore(spark, store.path, schema, group="doc_id", buckets=8).merge(spark.createDataFrame([], schema))
