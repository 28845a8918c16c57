"""The Jaccard join against all pairs."""

import random

import numpy as np
import pytest

from tessera.llm import jaccardjoin as jj
from tessera.llm import neardup as nd
from tessera.llm import textkit as tk

from . import brute
from .test_dedup import edited, frame, words


def joined(spark, rows, **k):
    got = jj.jaccard_join(frame(spark, rows), **k).collect()
    return sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id if r.component_id is not None else -1) for r in got)


def want(rows, k, num, den):
    found = brute.near_components(rows, k, num, den)
    return sorted((d if d is not None else -1, n, (c if c is not None else -1) if n else (d if d is not None else -1)) for (d, _), (n, c) in zip(rows, found, strict=True))


def mixed_rows(rng):
    rows = []
    for size in (9, 10, 11, 12, 20, 21, 30, 60, 150, 400):
        base = words(rng, size, 400)
        rows += [(None, edited(rng, base, e)) for e in (0, 1, 1, 2, 3)] + [(None, " ".join(base[: size - c])) for c in (1, 2, 3)]
        rows += [(None, " ".join(base) + " " + " ".join(words(rng, c, 400))) for c in (1, 2, size // 10 + 1)]
    frequent = words(rng, 8, 400)
    rows += [(None, " ".join(words(rng, rng.randrange(1, 30), 400) + frequent)) for _ in range(60)]
    rng.shuffle(rows)
    return [(i * 5 - 30, t) for i, (_, t) in enumerate(rows)]


@pytest.mark.parametrize("boundary", [None, 0, 25, 400])
def test_join_equals_all_pairs(spark, monkeypatch, boundary):
    """Whatever the boundary between light and heavy sets, the links are the same."""
    if boundary is not None:
        monkeypatch.setattr(jj, "boundary_of", lambda *a: boundary)
    rows = mixed_rows(random.Random(8))
    assert joined(spark, rows) == want(rows, 3, 9, 10)


@pytest.mark.parametrize("boundary", [0, 300])
def test_join_of_one_hot_group(spark, monkeypatch, boundary):
    """Near copies around the threshold: hubs leave buckets open, blocks decide them."""
    monkeypatch.setattr(jj, "boundary_of", lambda *a: boundary)
    monkeypatch.setattr(nd, "ROUNDS", 1)
    rng = random.Random(3)
    base, far = words(rng, 140), words(rng, 150)
    rows = [(i, edited(rng, base if i % 3 else far, rng.randrange(1, 5))) for i in range(300)] + [(400 + i, " ".join(words(rng, rng.randrange(1, 80), 60))) for i in range(60)]
    assert joined(spark, rows) == want(rows, 3, 9, 10)
    assert joined(spark, rows[::2], num=17, den=20) == want(rows[::2], 3, 17, 20)


def test_join_edge_rows(spark):
    same = "alpha beta gamma delta epsilon zeta"
    rows = [(5, same), (3, same.upper()), (9, same), (9, same), (1, None), (2, ""), (4, " \t\n"), (7, "one two"), (8, "One\x0bTWO"), (None, same), (None, None), (None, "solo words here"), (11, "x " * 30000)]
    assert joined(spark, rows) == want(rows, 3, 9, 10)
    assert joined(spark, []) == [] and joined(spark, [(1, None)]) == [(1, 0, 1)]


def test_join_of_very_long_texts(spark):
    rng = random.Random(4)
    base = words(rng, 60000, 10**6)
    rows = [(1, " ".join(base)), (2, edited(rng, base, 900)), (3, edited(rng, base, 4000)), (4, " ".join(base[:56000]))]
    assert joined(spark, rows) == want(rows, 3, 9, 10)


def test_words_of_opposite_letters_are_told_apart(spark):
    """Sums of letters by powers vanish on such pairs in arithmetic modulo a power of two."""
    rows, flip = [], str.maketrans("ab", "ba")
    w = "a"
    while len(w) < 4096:
        w += w.translate(flip)
        rows += [(len(rows), w), (len(rows) + 1, w.translate(flip))] if len(w) >= 32 else []
    assert joined(spark, rows) == want(rows, 3, 9, 10) == [(i, 1, i) for i in range(len(rows))]
    got = nd.near_duplicates(frame(spark, rows), 3, 85, 100).collect()
    assert all(r.kept for r in got)
    raw = np.frombuffer("".join(t for _, t in rows).encode(), np.uint8)
    ends = np.cumsum([len(t) for _, t in rows])
    starts = ends - [len(t) for _, t in rows]
    assert len(np.unique(tk.range_hash(tk.prefix_hash(raw), starts, ends))) == len(rows)


def test_bitmaps_never_differ_in_more_bits_than_sets_in_shingles():
    import pyarrow as pa

    rng = np.random.default_rng(5)
    for n, m in ((10, 9), (120, 130), (700, 650), (3000, 1000)):
        h = [np.unique(rng.integers(0, 2**63, x).astype(np.uint64)) for x in (n, m)]
        h[1][: m // 2] = h[0][: m // 2]
        h = [np.unique(x) for x in h]
        marks = [pa.array(jj.parities(x, np.array([0, len(x)])), pa.binary()) for x in h]
        assert jj.bit_distance(*marks)[0] <= len(np.setxor1d(*h))
