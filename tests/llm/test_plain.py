"""The kernels of the learnt operators against plain restatements, text by text and window by window."""

import math
import re
from collections import Counter

import numpy as np

from tessera.llm import langid, toxicity
from tessera.llm import textkit as tk
from tessera.llm.linear import DIM, Ftrl, sigmoid, word_ngrams, word_presence

from . import brute

TEXTS = ["The the cat; sat. On MAT 12 times", "", "  \t", "é É ünï!! ??? a", "NASA 9x ab12 ... Cd", "x", "word " * 400 + "Ends HERE", "\x7f\x00a b c"]
RUN = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e]+")


def block(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])


def hashed(token):
    """The hash of one folded token, eight bytes at a time."""
    token = bytes(c + 32 if 65 <= c <= 90 else c for c in token)
    out = tk.mix64(np.array([len(token)], np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1))
    for i in range(0, len(token), 8):
        out = tk.mix64(out ^ np.uint64(int.from_bytes(token[i : i + 8], "little")))
    return int(out[0])


def shape(token):
    if not (token[:1].isalnum() or token[0] >= 128):
        return min(len(token), 3)
    upper, high = sum(65 <= c <= 90 for c in token), sum(c >= 128 for c in token)
    if 48 <= token[0] <= 57:
        return 4
    if upper + high == len(token) and upper > 1:
        return 5
    return 6 if upper == 0 else 7 if upper == 1 else 8


def plain_ngrams(text):
    mix = lambda x: int(tk.mix64(np.array([x % 2**64], np.uint64))[0])
    tokens = RUN.findall(text.encode())
    h, s = [hashed(t) for t in tokens], [shape(t) for t in tokens]
    out = list(h)
    out += [mix(a * 0xC2B2AE3D27D4EB4F + b) for a, b in zip(h, h[1:])]
    out += [77 for a, b in zip(h, h[1:]) if a == b]
    out += [mix(a * 100 + b * 10 + c + (1 << 40)) for a, b, c in zip(s, s[1:], s[2:])]
    return Counter(x % DIM for x in out)


def test_word_ngrams_text_by_text():
    f, d = word_ngrams(*block(TEXTS))
    for i, t in enumerate(TEXTS):
        assert Counter(f[d == i].tolist()) == plain_ngrams(t), t


def test_word_presence_text_by_text():
    f, d = word_presence(*block(TEXTS))
    for i, t in enumerate(TEXTS):
        words = re.findall(rb"[0-9A-Za-z\x80-\xff]+", t.encode())
        assert sorted(f[d == i].tolist()) == sorted({hashed(w) % DIM for w in words}), t


def test_scores_are_sparse_dot_products():
    rng = np.random.default_rng(3)
    w, theta = rng.normal(size=DIM).astype(np.float32), np.array([0.3, 1.1])
    data, offsets = block(TEXTS)
    f, d = word_ngrams(data, offsets)
    total = np.bincount(d, weights=w[f].astype(float), minlength=len(TEXTS)) / np.maximum(np.bincount(d, minlength=len(TEXTS)), 1)
    for i, t in enumerate(TEXTS):
        grams = plain_ngrams(t)
        want = sum(float(w[x]) * n for x, n in grams.items()) / max(sum(grams.values()), 1)
        assert math.isclose(total[i], want, rel_tol=1e-9, abs_tol=1e-9)
    # Expected severity: the sum of the probabilities of exceeding each threshold, by one common sum of weights.
    f, d = word_presence(data, offsets)
    for i, t in enumerate(TEXTS):
        eta = sum(float(w[hashed(x) % DIM]) for x in {bytes(b).lower() for b in re.findall(rb"[0-9A-Za-z\x80-\xff]+", brute.fold(t).encode())})
        p = [1 / (1 + math.exp(-(eta - k))) for k in theta]
        got = sigmoid(np.array([w[f[d == i]].astype(float).sum()])[:, None] - theta)[0]
        assert np.allclose(got, p) and p[0] >= p[1]
    assert toxicity.best_cut(np.array([0, 0, 1, 1]), np.array([0.1, 0.2, 0.7, 0.9])) == (0.2 + 0.7) / 2


def test_ftrl_coordinate_by_coordinate():
    rng = np.random.default_rng(4)
    model = Ftrl(dim=6, alpha=0.3, beta=1.0, l1=0.05, l2=0.01)
    z, n = [0.0] * 6, [0.0] * 6

    def weight(i):
        return 0.0 if abs(z[i]) <= 0.05 else -(z[i] - math.copysign(0.05, z[i])) / ((1.0 + math.sqrt(n[i])) / 0.3 + 0.01)

    for _ in range(40):
        f = rng.choice(6, 3, replace=False)
        g = rng.normal(size=3)
        w = model.weights(f)
        assert np.allclose(w, [weight(i) for i in f])
        model.step(f, w, g)
        for i, x, gi in zip(f.tolist(), [weight(i) for i in f], g.tolist()):
            s = (math.sqrt(n[i] + gi * gi) - math.sqrt(n[i])) / 0.3
            z[i], n[i] = z[i] + gi - s * x, n[i] + gi * gi


def test_languages_of_long_texts_window_by_window():
    rng = np.random.default_rng(5)
    rows = 40
    windows = rng.integers(1, 20, (rows, langid.WINDOW)).astype(np.int32)
    model = langid.train(windows, rng.integers(0, 3, rows), ["a", "b", "c"])
    texts = ["short", "", "é" * 300, "some words here " * 200, "x" * langid.WINDOW, "y" * (langid.WINDOW + 1)]
    got = langid.text_posteriors(model, *block(texts), chunk=3)
    for i, t in enumerate(texts):
        raw, want = np.frombuffer(t.encode(), np.uint8), np.zeros(3)
        for a in range(0, len(raw), langid.WINDOW):
            part = raw[a : a + langid.WINDOW]
            x = np.zeros((1, langid.WINDOW), np.int32)
            x[0, : len(part)] = langid.SYMBOLS[part]
            want += model.posteriors(x)[0] * len(part)
        assert np.allclose(got[i], want / max(len(raw), 1), atol=1e-6)
