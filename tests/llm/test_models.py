import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import langid, mixing, quality, toxicity
from tessera.llm.linear import held, thinned

DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{DIR}/labels.parquet")


def odd(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "12 34 !!"), (5, "the and of this that " * 4000), (None, "the text of"), (6, "the text of"), (6, "the text of")]
    return spark.createDataFrame([(i, t, 0.5, 1, "x") for i, t in rows], "doc_id long, text string, score double, grade int, lang string")


def auc(y, s):
    rank = np.argsort(np.argsort(s))
    n = y.sum()
    return (rank[y == 1].sum() - n * (n - 1) / 2) / (n * (len(y) - n))


def test_quality_held_out(spark, docs, labels):
    out = held("doc_id", 3, 1)
    w, b = quality.fit_quality(docs, labels, ~out)
    got = quality.score_quality(docs, w, b, [F.col("doc_id"), out.alias("held")]).join(labels, "doc_id").where("held and quality is not null").toPandas()
    assert len(got) > 80 and auc(got.quality.values, got.score.values) > 0.97
    rows = quality.score_quality(odd(spark), w, b, [F.col("doc_id")]).collect()
    assert len(rows) == 8 and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (6, None)}) == 1  # equal texts, equal scores
    assert len({r.score for r in rows if r.doc_id in (1, 2, 3)}) == 1
    assert quality.score_quality(odd(spark).limit(0), w, b, [F.col("doc_id")]).count() == 0


def test_quality_without_labels(spark, docs, labels):
    w, b = quality.fit_quality(docs, labels.limit(0))
    assert not w.any() and b == 0.0


def test_toxicity_held_out(spark, docs, labels):
    out = held("doc_id", 3, 1)
    model = toxicity.fit_toxicity(docs, labels, ~out)
    assert model.thresholds[0] < model.thresholds[1]
    got = toxicity.score_toxicity(docs, model, [F.col("doc_id"), out.alias("held")]).withColumnRenamed("toxic", "flag").join(labels, "doc_id").where("held").toPandas()
    assert auc(got.toxic.values, got.severity.values) > 0.85
    assert got[got.toxic == 0].flag.mean() < 0.05
    rows = toxicity.score_toxicity(odd(spark), model, [F.col("doc_id")]).collect()
    assert len(rows) == 8 and all(0 <= r.severity <= 2 and r.p_1 >= r.p_2 for r in rows)
    none = toxicity.fit_toxicity(docs, labels.limit(0))
    assert toxicity.score_toxicity(odd(spark), none, [F.col("doc_id")]).where("toxic or grade > 0").count() == 0


def test_language_held_out(spark, docs):
    out = held("doc_id", 4, 2)
    model = langid.fit_langid(docs, ~out)
    got = langid.predict_languages(docs, model, [F.col("doc_id"), F.col("lang"), out.alias("held")]).where("held").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.97
    rows = langid.predict_languages(odd(spark), model, [F.col("doc_id")]).collect()
    assert {r.doc_id: r.lang_pred for r in rows if r.doc_id in (1, 2, 3, 4)} == dict.fromkeys((1, 2, 3, 4), "und")
    assert all(0 <= r.score <= 1 for r in rows) and {r.lang_pred for r in rows if r.doc_id == 6} == {"en"}
    empty = langid.fit_langid(docs.limit(0))
    assert {r.lang_pred for r in langid.predict_languages(odd(spark), empty, [F.col("doc_id")]).collect()} == {"und"}


def test_pair_tables_equal_plain_convolution():
    """The network's filters, taken back from its pair tables' sums, slide symbol by symbol."""
    rng = np.random.default_rng(1)
    one = {w: rng.normal(size=(w, langid.N_SYMBOLS, langid.FILTERS)).astype(np.float32) for w in langid.WIDTHS}
    pairs = {w: np.stack([(e[2 * j][:, None] + e[2 * j + 1][None]).reshape(-1, langid.FILTERS) for j in range(w // 2)]) for w, e in one.items()}
    total = len(langid.WIDTHS) * langid.FILTERS
    model = langid.ByteCnn(["a", "b"], pairs, rng.normal(size=total), rng.normal(size=(total, 2)), rng.normal(size=2))
    windows = langid.SYMBOLS[rng.integers(32, 250, (6, langid.WINDOW))]
    want = []
    for x in windows:
        pooled = [max(sum(float(one[w][j, x[i + j], f]) for j in range(w)) for i in range(langid.WINDOW - w + 1)) for w in langid.WIDTHS for f in range(langid.FILTERS)]
        z = np.maximum(np.array(pooled) + model.bias, 0) @ model.out + model.out_bias
        want.append(np.exp(z - z.max()) / np.exp(z - z.max()).sum())
    assert np.allclose(model.posteriors(windows), want, atol=1e-4)


def test_scores_equal_plain_python_on_fixed_weights(spark):
    """Quality: mean weight of all n-grams; severity: distinct words against the thresholds. Words are hashed by the same kernel."""
    from tessera.llm import textkit as tk
    from tessera.llm.linear import DIM, word_ngrams, word_presence

    rng = np.random.default_rng(2)
    w = rng.normal(size=DIM).astype(np.float32)
    texts = ["", "One two two THREE", "é 12 !! one", "word " * 9000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    q = {r.doc_id: r.score for r in quality.score_quality(df, w, 0.25, [F.col("doc_id")]).collect()}
    model = toxicity.Ordinal(w, np.array([0.5, 1.5]), 0.7)
    got = {r.doc_id: r for r in toxicity.score_toxicity(df, model, [F.col("doc_id")]).collect()}
    for i, t in enumerate(texts):
        raw = np.frombuffer(t.encode(), np.uint8)
        f = [int(x) for x in word_ngrams(raw, np.array([0, len(raw)]))[0]]
        assert abs(q[i] - 1 / (1 + np.exp(-(sum(float(w[x]) for x in f) / max(len(f), 1) + 0.25)))) < 1e-6
        eta = sum(float(w[x]) for x in set(word_presence(raw, np.array([0, len(raw)]))[0].tolist()))
        p1, p2 = (1 / (1 + np.exp(-(eta - c))) for c in (0.5, 1.5))
        assert abs(got[i].severity - p1 - p2) < 1e-6 and got[i].toxic == (p1 + p2 >= 0.7) and got[i].grade == (p1 >= 0.5) + (p2 >= 0.5)
    # A repeated word: words, pairs, repeats and shapes of a known text.
    assert len(word_ngrams(np.frombuffer(b"a a b", np.uint8), np.array([0, 5]))[0]) == 3 + 2 + 1 + 1
    assert tk.U64 is np.uint64


def test_a_text_with_many_copies_does_not_fill_the_sample(spark):
    rows = [(i, "the same english text again and again", "en") for i in range(3000)] + [(5000 + i, f"ein deutscher satz mit der nummer {i}", "de") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.fit_langid(docs, max_texts=50).langs == ["de", "en"]


def test_long_labelled_texts_keep_all_features(spark):
    from tessera.llm.linear import gather, word_ngrams

    text = " ".join(f"w{i}" for i in range(9000))
    docs = spark.createDataFrame([(1, text), (1, text), (2, "a b")], "doc_id long, text string")
    sample = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, y int")
    assert sorted(len(f) for _, f, _ in gather(docs, sample, word_ngrams, 10**6)) [-1] > 15_000
    assert [len(f) for _, f, _ in gather(docs, sample, word_ngrams, 100)] == [5] or len(gather(docs, sample, word_ngrams, 100)) == 1


def test_mixing_meets_its_targets(spark, docs, labels):
    got = mixing.mix(docs, labels, columns=[F.col("doc_id")]).toPandas()
    total = got.p_tokens.sum()
    for c, share in mixing.TARGETS.items():
        assert abs((got.p_tokens * got.p_rate * got[f"p_{c}"]).sum() / total - share) < 0.005, c
    assert (got.p_rate >= 0).all() and ((got.p_copies - got.p_rate).abs() < 1).all()
    assert abs((got.p_tokens * got.p_copies).sum() / total - 1) < 0.1


def plain_nnls(p, t, goal, ridge=mixing.RIDGE, rounds=200_000):
    """The same least squares by cyclic coordinate descent on the dual numbers' fixed point: slow, but another method."""
    share = t / t.sum()
    z = np.zeros(p.shape[1])
    for _ in range(rounds):
        r = np.maximum(1 - p @ z / ridge, 0)
        active = r > 0
        res = (share * r) @ p - goal
        if np.abs(res - z).max() < 1e-10:
            break
        jac = (p[active] * share[active, None]).T @ p[active] / ridge + np.eye(len(z))
        step = np.linalg.solve(jac, res - z)
        scale, gap = 1.0, np.abs(res - z).max()
        while scale > 1e-6:
            new = z + scale * step
            r2 = np.maximum(1 - p @ new / ridge, 0)
            if np.abs((share * r2) @ p - goal - new).max() < gap:
                break
            scale /= 2
        z = z + scale * step
    return np.maximum(1 - p @ z / ridge, 0)


@pytest.mark.parametrize("goal", [[0.6, 0.3, 0.1], [0.0, 0.5, 0.5], [0.1, 0.1, 0.8]])
def test_mixing_rates_solve_the_least_squares(spark, goal):
    """Production parameters against another solver; the last targets cannot be met by any rates that keep the budget."""
    rng = np.random.default_rng(4)
    p = np.round(rng.dirichlet([1, 1, 1] if goal[2] < 0.8 else [4, 4, 1], 200), 3)
    t = rng.integers(1, 500, 200)
    df = spark.createDataFrame([(*map(float, x), float(n)) for x, n in zip(p, t, strict=True)], "p_good double, p_poor double, p_toxic double, p_tokens double")
    fit = mixing.fit_rates(df, dict(zip(mixing.DOMAINS, goal, strict=True)))
    got = mixing.with_rates(df, fit).toPandas()
    want = plain_nnls(got[["p_good", "p_poor", "p_toxic"]].values, got.p_tokens.values, np.array(goal))
    assert fit.converged and (got.p_rate >= 0).all()

    def value(r):
        share = got.p_tokens.values / got.p_tokens.sum()
        return (((share * r) @ got[["p_good", "p_poor", "p_toxic"]].values - goal) ** 2).sum() / 2 + mixing.RIDGE / 2 * (share * (r - 1) ** 2).sum()

    assert value(got.p_rate.values) <= value(want) + 2e-5
    with pytest.warns(UserWarning):
        assert not mixing.fit_rates(df, {"good": 0.6, "poor": 0.3, "toxic": 0.1}, steps=3).converged


def test_mixing_edge_rows(spark, labels, docs):
    got = mixing.mix(odd(spark), labels, columns=[F.col("doc_id"), F.col("score")]).collect()
    assert len(got) == 8 and mixing.mix(odd(spark).limit(0), labels, columns=[F.col("doc_id")]).count() == 0


def test_thinning_keeps_the_smallest_places(spark):
    rows = spark.range(60_000)
    place = F.xxhash64("id")
    want = rows.orderBy(F.pmod(place, F.lit(1_000_000_007)), "id").limit(50)
    assert [r.id for r in thinned(rows, place, 50).collect()] == [r.id for r in want.collect()]
    assert thinned(rows.limit(0), place, 50).count() == 0
    docs = rows.select("id", F.concat(F.lit("text number "), "id").alias("text"), F.lit("en").alias("lang"))
    assert langid.fit_langid(docs, max_texts=64).langs == ["en"]


def test_repeated_rows_of_a_sample_are_collected_once(spark, monkeypatch):
    """The driver takes as many rows as there are different ones, whatever their number of copies, and learns the same."""
    from tessera.llm import linear

    docs = spark.createDataFrame([(i, f"word{i} and more words") for i in range(6)], "doc_id long, text string")
    sample = spark.createDataFrame([(i, i % 2) for i in range(6)], "doc_id long, y int")
    once = linear.gather(docs, sample, linear.word_ngrams, 1000)
    took = []
    many = docs.crossJoin(spark.range(50).select()).repartition(5)
    assert many.count() == 300
    seen = type(docs).toArrow
    monkeypatch.setattr(type(docs), "toArrow", lambda df: took.append(seen(df)) or took[-1])
    again = linear.gather(many, sample, linear.word_ngrams, 1000)
    assert [len(t) for t in took] == [6, 6]
    assert [(y, f.tolist(), c.tolist()) for y, f, c in again] == [(y, f.tolist(), c.tolist()) for y, f, c in once] and len(again) == 6
