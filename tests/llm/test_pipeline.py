import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tessera.llm.langid import fit_langid, predict_languages

from . import brute

DIR = "/root/testdata/sf0.001"


def test_stages_on_odd_rows(spark):
    """Nulls, empty and repeated rows, and extra columns named like the operators' own, go through every stage."""
    good = spark.read.parquet(f"{DIR}/documents.parquet").limit(20).select("doc_id", "text", "lang", "source", "n_chars")
    odd = spark.createDataFrame([(None, None, None, None, None), (900, "", "en", "s", 0), (901, "some text here " * 9, None, "s", 1), (901, "some text here " * 9, None, "s", 1)], good.schema)
    docs = good.union(odd).withColumn("shard", F.lit(77)).withColumn("score", F.lit("x")).withColumn("key", F.lit(1))
    for empty in (False, True):
        at = docs.limit(0) if empty else docs
        for name, stage in cp.STAGES:
            out = stage(spark, at, DIR)
            assert out.columns == docs.columns, name
            n = out.count()
            assert (n == 0) == empty or not empty, name


def test_run_matches_the_contract(spark):
    rows = cp.run(spark, DIR).collect()
    assert rows and rows[0].asDict().keys() == {"doc_id", "text", "lang", "source", "n_chars", "shard"}
    assert all(r["shard"] == brute.jump(r.doc_id, 24) for r in rows)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    assert not brute.leaks(list({(r.doc_id, r.text) for r in rows}), items)


def test_near_dedup_keeps_one_of_each_group(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    kept = {r.doc_id for r in cp.near_dedup(spark, docs, DIR).collect()}
    assert kept == {d for (d, _), (n, c) in zip(rows, brute.near_components(rows, 5, 4, 5), strict=True) if not n or d == c}


def test_near_dedup_tells_rows_of_one_id_apart(spark):
    """A dropped text does not come back when another text of its doc_id stays; of repeated rows one stays, whatever else differs."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a, "en", 0), (2, a, "en", 0), (2, b, "en", 0), (3, c, "en", 0), (3, c, "de", 5), (3, c, "de", 5), (None, None, "en", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, __score int").withColumn("__id", F.lit("x")).withColumn("___text", F.lit(1))
    got = cp.near_dedup(spark, docs, DIR)
    assert got.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "", r.lang) for r in got.collect()) == [(0, "", "en"), (1, a, "en"), (2, b, "en"), (3, c, "de")]


def test_scratch_tables_go(spark, tmp_path):
    from tessera import session

    assert session.scratch_root(spark)
    out = session.settled(lambda: session.materialize(spark.range(5), "inner").selectExpr("id + 1 as id"), "outer")
    assert sorted(r.id for r in out.collect()) == [1, 2, 3, 4, 5]
    session.discard(out)


def test_mixing_keeps_a_column_named_like_its_draw(spark):
    """Failed before: the draw stood under a fixed name beside the table's own column."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(20).withColumn("__draw", F.lit("own"))
    out = cp.mixing(spark, docs, DIR)
    assert out.columns == docs.columns
    assert {r["__draw"] for r in out.collect()} <= {"own"}


def test_stages_on_odd_columns_and_a_very_long_text(spark):
    """Columns named like the stages' own, of types without an order and with odd field names, and a text of 5 MB go through all stages."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(30)
    long = spark.createDataFrame([(5000, " ".join(f"word{i % 70001}" for i in range(500_000)), "en", "s", 5_000_000)] * 2, docs.schema)
    docs = docs.union(long).withColumns({c: F.lit("own") for c in ("__id", "__hash", "__best", "__text", "__letters", "p_good")})
    docs = docs.withColumn("a map", F.create_map(F.lit("k"), F.lit(1))).withColumn("odd", F.struct(F.lit(1).alias("a-b"), F.array(F.lit(2)).alias("a b")))
    docs = docs.unionByName(docs.limit(3))
    for name, stage in cp.STAGES:
        out = stage(spark, docs, DIR)
        assert set(out.columns) - {"shard"} == set(docs.columns), name
        assert {r["odd"]["a-b"] for r in out.select("odd").collect()} <= {1}, name
    again = cp.near_dedup(spark, docs, DIR).collect()
    assert len({(r.doc_id, r.text) for r in again}) == len(again) and sum(r.doc_id == 5000 for r in again) == 1
    assert predict_languages(docs, fit_langid(docs, F.lit(True)), [F.col("doc_id"), F.col("__best")]).count() == docs.count()


def test_stages_hand_rows_to_python_in_small_batches(spark, monkeypatch):
    """Failed before: a batch held 10,000 rows of up to 64 MB, in the executor and in its Python workers. A number that the session names itself stays."""
    from tessera.session import BATCH, BATCH_BYTES

    wide = spark.range(3000, numPartitions=1).select("id", F.repeat(F.lit("x"), 10_000).alias("t"))
    seen = []

    def operator(*_, **__):
        seen.append(max(r.n for r in wide.mapInArrow(lambda bs: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in bs), "n long").collect()))
        raise InterruptedError

    for name in ("fit_quality", "near_duplicates", "without_leaks", "mix"):
        monkeypatch.setattr(cp, name, operator)
    docs, held = spark.read.parquet(f"{DIR}/documents.parquet"), spark.conf.get(BATCH, None)
    try:
        for own, most in ((None, BATCH_BYTES), (1 << 20, 1 << 20)):
            for _, stage in cp.STAGES[:-1]:
                spark.conf.unset(BATCH) if own is None else spark.conf.set(BATCH, str(own))
                with pytest.raises(InterruptedError):
                    stage(spark, docs, DIR)
            assert len(seen) == 4 and max(seen) < 1.1 * most
            seen.clear()
    finally:
        spark.conf.unset(BATCH) if held is None else spark.conf.set(BATCH, held)
