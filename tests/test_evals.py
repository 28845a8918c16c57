import math

from pyspark.sql import functions as F

from tessera.operators import evals


def test_percentiles_round_half_to_even(spark):
    for n in (1, 2, 5, 10, 15, 30, 50):
        df = spark.createDataFrame([("a", float(i % 7)) for i in range(n)], "k string, v double")
        values = sorted(float(i % 7) for i in range(n))
        want = [values[max(0, min(n - 1, round(p / 100 * n) - 1))] for p in (50, 95)]
        r = evals.percentiles(df, "k", "v").first()
        assert [r.p50, r.p95] == want, n


def test_hit_rates_count_missing_as_misses(spark):
    df = spark.createDataFrame([("m", 1), ("m", 4), ("m", None)], "mode string, rank int")
    r = evals.hit_rates(df, ["mode"]).first()
    assert (r.n, r.recall_1, r.recall_5, r.mrr) == (3, 1 / 3, 2 / 3, (1 + 0.25) / 3)


def test_pooled_relevance(spark):
    hits = spark.createDataFrame([(0, "a", 1, "m"), (0, "b", 2, "m"), (1, "c", 1, "m")], "query_id long, chunk_id string, rank int, mode string")
    qrels = spark.createDataFrame([(0, "a", 1), (0, "b", 3), (0, "z", 2), (1, "c", 0)], "query_id long, chunk_id string, grade int")
    got = {r.query_id: r for r in evals.pooled_eval(hits, qrels).collect()}
    ideal = 3 + 2 / math.log2(3) + 1 / 2
    assert abs(got[0].ndcg - (1 + 3 / math.log2(3)) / ideal) < 1e-12 and got[0].set_recall == 0.5
    assert got[1].set_recall is None and got[1].ndcg == 0.0
    r = evals.pooled_summary(evals.pooled_eval(hits, qrels)).first()
    assert r.n == 1 and abs(r.ndcg - got[0].ndcg / 2) < 1e-12


def test_judgments(spark):
    texts = ['{"correctness": 4, "groundedness": "5", "citation_quality": 9, "rationale": "r"}', 'x ```json\n{"correctness": 2.9}\n``` y', "prose only", None]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "custom_id string, t string").select("custom_id", evals.parse_judgment(F.col("t")).alias("j")).select("custom_id", "j.*")
    got = {r.custom_id: (r.correctness, r.groundedness, r.citation_quality) for r in df.collect()}
    assert got == {"0": (4, 5, 5), "1": (2, 0, 0), "2": (0, 0, 0), "3": (0, 0, 0)}
    rows = spark.createDataFrame([("0",), ("q",)], "custom_id string")
    assert {r.custom_id: r.correctness for r in evals.align_judgments(rows, df).collect()} == {"0": 4, "q": 0}


def test_judge_means_skip_zeros(spark):
    df = spark.createDataFrame([("m", 4, 0, 0), ("m", 0, 2, 0)], "mode string, correctness int, groundedness int, citation_quality int")
    r = evals.judge_means(df, "mode").first()
    assert (r.correctness, r.groundedness, r.citation_quality, r.quality) == (4.0, 2.0, 0.0, 3.0)


def test_routing_cost_oov_and_trace(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(evals.routing_correct(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("a"), F.lit("a")))) and not one(evals.routing_correct(F.array(F.lit("a")), F.array(F.lit("a"), F.lit("b"))))
    assert one(evals.cost_usd(*map(F.lit, (1000, 100, 10, 5)))) == round((3000 + 1500 + 37.5 + 1.5) / 1e6, 6)
    assert one(evals.cache_hit_ratio(*map(F.lit, (0, 0, 0)))) == 0.0
    ranks = spark.createDataFrame([("q", "keyword_only", 1), ("q", "vector_only", None), ("q", "hybrid_rerank", 2), ("r", "vector_only", 1)], "query string, mode string, rank int")
    assert tuple(evals.oov_summary(ranks).first()) == (1, 1, 1)
    trace = spark.createDataFrame([("search_docs", [("s",), (None,)]), ("get_document", [("t",)]), ("search_x", None)], "tool string, results array<struct<snippet: string>>")
    assert [r.hit.snippet for r in evals.search_hits(trace).collect()] == ["s"]
    text = evals.report(spark.createDataFrame([("m", 0.5)], "mode string, mrr double"), "T", ["mode"])
    assert text.startswith("## T\n\n| mode | mrr |") and "| m | 0.500 |" in text
