"""Plain restatements that the operators are held against."""

import hashlib
import re
from collections import Counter


def fold(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def blank_words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", fold(t))


def plain_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(t))


def shingles(words, k):
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)])


def near_components(rows, k, num, den):
    """Per row (index): set size and the smallest doc_id reachable."""
    sets = [shingles(blank_words(t), k) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                up[root(i)] = root(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[root(i)] = min(d, ids.get(root(i), d))
    return [(len(s), ids.get(root(i))) for i, s in enumerate(sets)]


def removed(rows, length):
    """{doc_id: (bytes, removed, spans, digest)} for rows of distinct doc_ids."""
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out[d] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def leaks(docs, items, k=5, num=4, den=5):
    """Pairs (doc_id, item_id) with a window of the item's size, aligned on a shared shingle, that is similar enough."""

    def weighted(words):
        n = min(k, len(words))
        return {tuple(words[i : i + n]): 1 + sum(len(w) >= 4 for w in words[i : i + n]) for i in range(len(words) - n + 1)} if words else {}

    out = set()
    for d, t in docs:
        w = plain_words(t)
        for i, x in items:
            v = plain_words(x)
            n = min(k, len(v))
            if not v:
                continue
            starts = {max(0, min(p - q, len(w) - len(v))) for p in range(len(w) - n + 1) for q in range(len(v) - n + 1) if w[p : p + n] == v[q : q + n]}
            for s in starts:
                a, b = weighted(w[s : s + len(v)]), weighted(v)
                both = sum(c for y, c in a.items() if y in b)
                if den * both >= num * sum({**a, **b}.values()):
                    out.add((d, i))
    return out


def jump(key, shards):
    """Jump consistent hash of a 64-bit key, as published."""
    b, j, key = -1, 0, key % 2**64
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2.0**31 / ((key >> 33) + 1)))
    return b


def bag(rows):
    return Counter(map(tuple, rows))


def license_labels(text, base, notices, k=3, gap=3, coverage=0.7):
    """Labels, first place of each notice and the best share of grams, over all windows of twice a template's length in each cluster of diagonals."""
    w = plain_words(text)
    labels, score, found = set(), 0.0, {}
    for label, phrase, is_base in [(x, t, True) for x, t in base.items()] + [(x, t, False) for x, t in notices.items()]:
        t = phrase.split()
        grams = len(t) - k + 1
        hits = [(p, q) for p in range(len(w) - k + 1) for q in range(grams) if w[p : p + k] == t[q : q + k]]
        if is_base and any(w[i : i + len(t)] == t for i in range(len(w) - len(t) + 1)):
            labels.add(label)
        clusters, before = [], None
        for d in sorted({p - q for p, q in hits}):
            if before is None or d - before > gap:
                clusters.append(set())
            clusters[-1].add(d)
            before = d
        for c in clusters:
            mine = sorted(h for h in hits if h[0] - h[1] in c)
            best = (0, 0)
            for p, _ in mine:
                inside = {q for x, q in mine if p <= x <= p + 2 * len(t) - k}
                best = max(best, (len(inside), -p))
            score = max(score, round(best[0] / grams, 6))
            if not is_base and best[0] / grams >= coverage:
                labels.add(label)
                found.setdefault(label, []).append(-best[1])
    return ",".join(sorted(labels)), score
