from pyspark.sql import functions as F

from tessera.config import RetrievalConfig
from tessera.operators import fusion
from tessera.operators.retrieve import keyword_router, retrieve
from tessera.operators.vector import cosine_search

LEG = "query_id long, chunk_id string, score double, rank int"


def leg(spark, prefix, n, score=lambda i: float(-i)):
    return spark.createDataFrame([(0, f"{prefix}{i:02d}", score(i), i + 1) for i in range(n)], LEG)


def order(df):
    return [r.chunk_id for r in df.orderBy("rank").collect()]


def test_alpha_one_keeps_one_keyword_hit_in_a_full_pool(spark):
    got = order(fusion.weighted(leg(spark, "b", 30), leg(spark, "v", 30), 30, 1.0))
    assert sum(x[0] == "b" for x in got) == 1 and got[:29] == [f"v{i:02d}" for i in range(29)] and got[29] == "b00"
    assert sum(x[0] == "b" for x in order(fusion.weighted(leg(spark, "b", 30), leg(spark, "v", 30), 30, 0.3))) == 21


def test_constant_single_and_empty_legs(spark):
    b, v = leg(spark, "b", 3, lambda i: 2.0), leg(spark, "v", 1)
    rows = {r.chunk_id: r.score for r in fusion.weighted(b, v, 10, 0.5).collect()}
    assert rows == {"b00": 0.5, "b01": 0.5, "b02": 0.5, "v00": 0.5}
    assert order(fusion.weighted(leg(spark, "b", 0), leg(spark, "v", 2), 10, 0.5)) == ["v00", "v01"]


def test_rrf_prefers_the_vector_leg_on_ties(spark):
    assert order(fusion.rrf(leg(spark, "b", 2), leg(spark, "v", 2), 4)) == ["v00", "b00", "v01", "b01"]
    both = fusion.rrf(leg(spark, "x", 2), leg(spark, "x", 2), 4).orderBy("rank").first()
    assert both.chunk_id == "x00" and abs(both.score - 2 / 61) < 1e-12


def test_floor_comes_after_the_cut(spark):
    pairs = spark.createDataFrame([(0, c, i + 1, s) for i, (c, s) in enumerate([("a", 0.9), ("b", 0.05), ("c", 0.5)])], "query_id long, chunk_id string, rank int, s double")
    assert order(fusion.rerank(pairs, 2, 0.1, F.col("s"))) == ["a", "c"]
    assert order(fusion.rerank(pairs, 3, 0.6, F.col("s"))) == ["a"]
    assert order(fusion.rerank(pairs, 3, 0.0, F.col("s"))) == ["a", "c", "b"]


def corpus(spark):
    chunks = spark.createDataFrame([("c1", "erp", "d1", "journal entry reversal", ["GL"]), ("c2", "erp", "d2", "accounts payable", ["AP"]), ("c3", "oci", "d3", "compute instance", ["OCI"])], "chunk_id string, product string, doc_id string, text string, section_path array<string>")
    vectors = spark.createDataFrame([("c1", "erp", "d1", [1.0, 0.0]), ("c2", "erp", "d2", [0.0, 1.0]), ("c3", "oci", "d3", [0.6, 0.8])], "chunk_id string, product string, doc_id string, embedding array<float>")
    queries = spark.createDataFrame([(0, "payable journal_x", [0.9, 0.1])], "query_id long, query string, q_vec array<float>")
    return chunks, vectors, queries


def test_modes(spark):
    chunks, vectors, queries = corpus(spark)
    for mode, want in [("keyword_only", ["c2"]), ("vector_only", ["c1", "c3", "c2"]), ("hybrid", None), ("hybrid_rerank", ["c2", "c1"])]:
        got = retrieve(chunks, vectors, queries, mode, 3).collect()
        assert want is None or [r.chunk_id for r in sorted(got, key=lambda r: r["rank"])] == want, mode
    assert {r.chunk_id for r in retrieve(chunks, vectors, queries, "vector_only", 3, "erp").collect()} == {"c1", "c2"}


def test_router_signals(spark):
    chunks, _, _ = corpus(spark)
    q = spark.createDataFrame([(0, "find oep_working"), (1, "accounts compute"), (2, "the of")], "query_id long, query string")
    alpha = lambda **k: {r.query_id: r.lexical for r in fusion.route(q, RetrievalConfig(**k), chunks).collect()}
    assert alpha() == {0: True, 1: False, 2: False}
    assert alpha(hybrid_adaptive_signal="idf") == {0: True, 1: True, 2: True}
    assert alpha(hybrid_adaptive_signal="both", hybrid_lex_df_max=-1) == {0: True, 1: False, 2: False}
    assert {(r.query_id, r["product"]) for r in keyword_router(q, {"erp": ["accounts"], "oci": ["compute"]}).collect()} == {(0, "erp"), (0, "oci"), (1, "erp"), (1, "oci"), (2, "erp"), (2, "oci")}


def test_cosine_in_several_passes(spark):
    _, vectors, _ = corpus(spark)
    q = vectors.select(F.monotonically_increasing_id().alias("query_id"), F.col("embedding").alias("q_vec"))
    one = sorted(map(tuple, cosine_search(vectors, q, 2).collect()))
    assert one == sorted(map(tuple, cosine_search(vectors, q, 2, max_queries=1).collect())) and len(one) == 6


def test_config_from_env(monkeypatch):
    monkeypatch.setenv("HYBRID_ALPHA", "0.7")
    monkeypatch.setenv("RERANK_INCLUDE_PATH", "0")
    cfg = RetrievalConfig.from_env()
    assert cfg.hybrid_alpha == 0.7 and cfg.rerank_include_path is False and cfg.stamp()["hybrid_fusion"] == "adaptive"
