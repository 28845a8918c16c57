import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import neardup as nd
from tessera.llm import textkit as tk
from tessera.llm.components import components
from tessera.llm.suffixdedup import remove_repeats

from . import brute

SCHEMA = "doc_id long, text string, source string, shard int, component_id long"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(d, t, "s", 1, 2) for d, t in rows], SCHEMA).repartition(parts)


def near(spark, rows, **k):
    got = nd.near_duplicates(frame(spark, rows), **k).collect()
    return sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id if r.component_id is not None else -1, r.kept) for r in got)


def want_near(rows, k, num, den):
    found = brute.near_components(rows, k, num, den)
    return sorted((d if d is not None else -1, n, (c if c is not None else -1) if n else (d if d is not None else -1), (c == d if n else True)) for (d, _), (n, c) in zip(rows, found, strict=True))


def words(rng, n, vocabulary=5000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def edited(rng, w, edits):
    w = list(w)
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


def test_near_duplicates_of_one_hot_group(spark):
    """Near copies whose mutual similarities lie around the threshold, so that many buckets stay open."""
    rng = random.Random(1)
    base = words(rng, 150)
    rows = [(i, edited(rng, base, rng.randrange(6))) for i in range(160)] + [(200 + i, " ".join(words(rng, rng.randrange(1, 80), 60))) for i in range(60)]
    assert near(spark, rows, k=3, num=85, den=100) == want_near(rows, 3, 85, 100)


def test_a_large_group_around_the_threshold_lists_few_links(spark, monkeypatch):
    """1200 copies, each with its own edits: many pairs on either side of the threshold, several components, and few listed links."""
    rng = random.Random(5)
    base, far = words(rng, 120), words(rng, 120)
    rows = [(i, edited(rng, base if i % 4 else far, rng.randrange(3, 8))) for i in range(1200)]
    listed = []
    real = nd.components
    monkeypatch.setattr(nd, "components", lambda edges: listed.append(edges.count()) or real(edges))
    grow = nd.contract
    monkeypatch.setattr(nd, "contract", lambda labels, edges: listed.append(edges.count()) or grow(labels, edges))
    assert near(spark, rows, k=3, num=85, den=100) == want_near(rows, 3, 85, 100)
    assert sum(listed) < 1200 * np.log2(1200)


def test_repeated_rows_without_id(spark):
    """Many rows without doc_id, of many texts, some repeated whole."""
    rng = random.Random(6)
    texts = [" ".join(words(rng, 40)) for _ in range(40)]
    rows = [(None, t) for t in texts] + [(None, texts[0])] * 30 + [(7, texts[1] + " more")] * 5
    assert near(spark, rows, k=3, num=85, den=100) == want_near(rows, 3, 85, 100)


def test_near_duplicates_edge_rows(spark):
    same = "alpha beta gamma delta epsilon zeta"
    rows = [(5, same), (3, same.upper()), (9, same), (9, same), (1, None), (2, ""), (4, " \t\n"), (7, "one two"), (8, "One\x0bTWO"), (None, same), (None, None), (None, "solo words here"), (11, "x " * 30000)]
    assert near(spark, rows, k=3, num=85, den=100) == want_near(rows, 3, 85, 100)
    assert near(spark, rows) == want_near(rows, 5, 4, 5)
    assert near(spark, []) == []


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(2)
    both, a, b = (rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2) for n in (8000, 1000, 1000))
    regs = []
    for x in (np.concatenate([both, a]), np.concatenate([both, b])):
        h, d, _ = tk.sorted_sets(x, np.zeros(len(x), np.int64), 1)
        regs.append(nd.sketch(h, d, 1))
    j, used = nd.estimate(*regs)
    assert used[0] == nd.REGISTERS and abs(j[0] - 0.8) < 0.15
    assert not nd.hopeless(regs[0], regs[1], 0.8)[0] and nd.hopeless(regs[0], nd.sketch(*(lambda s: (s[0], s[1], 1))(tk.sorted_sets(a, np.zeros(len(a), np.int64), 1))), 0.8)[0]
    assert (nd.densify(np.zeros((1, nd.REGISTERS), np.uint16)) == 0).all()


def test_components_of_chains_and_stars(spark):
    rng = random.Random(3)
    chain = [(i, i + 1) for i in range(0, 40)]
    star = [(100, 100 + i) for i in range(1, 30)]
    edges = chain + star + [(500, 501)]
    rng.shuffle(edges)
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 500: 500, 501: 500}


@pytest.mark.parametrize("length", [8, 20, 100])
def test_repeats_equal_brute_force(spark, length):
    rng = random.Random(length)
    piece = lambda n: "".join(rng.choice("abcé ") for _ in range(n))
    shared = [piece(length * 2), piece(length + 3), piece(length - 1)]
    rows = []
    for i in range(40):
        parts = [piece(rng.randrange(1, 3 * length)) if rng.random() < 0.6 else rng.choice(shared) for _ in range(rng.randrange(1, 6))]
        rows.append((i * 7 - 100, "".join(parts)))
    rows += [(900, rows[3][1]), (901, "ab" * length * 3), (902, "z" * (3 * length)), (903, ""), (904, None), (905, "z" * (length + 1)), (None, rows[5][1])]
    got = remove_repeats(frame(spark, rows), length).withColumn("sha", F.sha2("kept", 256)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.sha) for r in got} == brute.removed(rows, length)


def test_repeats_edge_rows(spark):
    text = "the same line of text that is long enough " * 3
    got = remove_repeats(frame(spark, [(1, text), (1, text), (2, text)]), 100).collect()
    assert [r.n_removed for r in sorted(got, key=lambda r: r.doc_id)] == [0, 0, 126]  # 126 bytes hold no window twice; doc 2 goes whole
    assert remove_repeats(frame(spark, []), 100).collect() == []


def test_many_equal_rows_stay_whole(spark):
    """Rows with one doc_id do not precede each other, however many; a later document of their text goes."""
    rng = random.Random(9)
    text = " ".join(words(rng, 60))
    got = remove_repeats(frame(spark, [(5, text)] * 300 + [(6, text)]), 100).collect()
    assert sorted({(r.doc_id, r.n_removed) for r in got}) == [(5, 0), (6, len(text))] and len(got) == 301


def test_word_kernel_equals_plain_words():
    texts = ["Ab  c\x0bD", "", "é x", "  ", "A", "a" * 5000 + " b"]
    raw = "".join(texts).encode()
    offsets = np.cumsum([0] + [len(t.encode()) for t in texts])
    s, e, d = tk.word_spans(np.frombuffer(raw, np.uint8), offsets, tk.NOT_BLANK)
    got = [[brute.fold(raw[a:b].decode()) for a, b, x in zip(s, e, d, strict=True) if x == i] for i in range(len(texts))]
    assert got == [brute.blank_words(t) for t in texts]
