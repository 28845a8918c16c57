import pytest
from pyspark.sql import functions as F

from tessera.operators import catalog
from tessera.schema import CHUNK, validate_chunks

ROWS = [("1", "erp", "gl", 1, "second", ["1 General Ledger"], "u"), ("2", "erp", "gl", 0, "first", ["1 General Ledger"], "u"), ("3", "oci", "vm-2x", 0, "vm", [], "u")]


def test_documents_topics_counts(spark):
    c = spark.createDataFrame(ROWS, CHUNK)
    doc = catalog.get_document(c, "gl").first()
    assert (doc.full_text, doc.title, doc["product"]) == ("first\n\nsecond", "1 General Ledger", "erp")
    assert catalog.get_document(c, "vm-2x").first().title == "Vm 2X"
    assert [r.topic for r in catalog.list_topics(c).collect()] == ["General Ledger"]
    assert {r["product"]: r.n for r in catalog.count_by_product(c).collect()} == {"erp": 2, "oci": 1}


def test_upsert_replaces_keeps_and_lets_the_last_win(spark):
    old = spark.createDataFrame([("a", "d", 0), ("b", "d", 0), ("c", "e", 0)], "id string, doc string, v int")
    new = spark.createDataFrame([("a", "d", 1), ("a", "d", 2), ("z", "f", 3)], "id string, doc string, v int")
    got = {r.id: r.v for r in catalog.upsert(old, new, order=F.col("v")).collect()}
    assert got == {"a": 2, "b": 0, "c": 0, "z": 3}
    assert {r.id for r in catalog.upsert(old, new, order=F.col("v"), replace="doc").collect()} == {"a", "c", "z"}


def test_reconcile_and_limits(spark):
    a = spark.createDataFrame([("x",), ("x",), ("y",)], "product string")
    b = spark.createDataFrame([("x",), ("x",), ("z",)], "product string")
    assert {r["product"]: r.status for r in catalog.reconcile(a, b).collect()} == {"x": "OK", "y": "MISMATCH", "z": "MISMATCH"}
    d = spark.createDataFrame([(g, i) for g in "ab" for i in range(4)], "g string, i int")
    assert catalog.first_per_group(d, "g", "i", 2).count() == 4


def test_validation(spark):
    bad = [("9", "erp", "gl", -1, "", ["x"], "u"), ("8", "xxx", "gl", 0, "t", ["x"], "u")]
    good, rejected = validate_chunks(spark.createDataFrame(ROWS + bad, CHUNK))
    assert good.count() == 3 and {r.id: r.errors for r in rejected.collect()} == {"9": ["text", "chunk_index"], "8": ["product"]}
    with pytest.raises(ValueError):
        validate_chunks(spark.createDataFrame(bad, CHUNK), strict=True)
    with pytest.raises(ValueError):
        validate_chunks(spark.createDataFrame(ROWS, CHUNK).withColumn("extra", F.lit(1)))
