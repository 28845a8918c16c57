import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import decontam, gifmedia, licenses, sharding

from . import brute

ODD = [(1, None), (2, ""), (3, "under the MIT License"), (3, "under the MIT License"), (None, "CC BY-NC 4.0 cc, by nc"), (4, "x under the mit\tlicense; Apache License, Version 2.0 " * 500), (5, "mİt under the mit licensé"), (6, "  ")]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 7, "y") for d, t in rows], "doc_id long, text string, tid int, label string")


def test_shards_equal_the_published_hash_and_move_only_forward(spark):
    ids = [0, 1, 5, -3, 2**62, -(2**63), *range(1000, 1300)]
    got = sharding.shard_documents(frame(spark, [(i, f"t{i}") for i in ids])).collect()
    assert {r.doc_id: (r.shard, r.grown_shard) for r in got} == {i: (brute.jump(i, 24), brute.jump(i, 25)) for i in ids}
    assert all(r.grown_shard in (r.shard, 24) for r in got)


def test_slots_are_gapless_and_repeated_rows_count(spark):
    rows = [(7, "same")] * 50 + [(None, None), (None, "é")] + [(i, "t" * (i % 9)) for i in range(300)]
    got = sharding.shard_documents(frame(spark, rows), rows_per_task=20).collect()
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r.slot)
    assert len(got) == len(rows) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert {(r.size, r.text_crc32) for r in got if r.doc_id is None} == {(8, 0), (10, __import__("zlib").crc32("é".encode()))}
    assert sharding.shard_documents(frame(spark, [])).count() == 0


def test_license_places_equal_brute_force(spark):
    rng = random.Random(5)
    rows = ODD + [(10 + i, " ".join(rng.choice(["under", "the", "MIT", "license", "apache", "version", "2", "cc", "by", "nc", "x,"]) for _ in range(60))) for i in range(40)]
    got = licenses.scan_licenses(frame(spark, rows)).collect()
    key = lambda d, n, *r: (d if d is not None else -1, n, *r)
    want = []
    for d, t in rows:
        w = brute.plain_words(t)
        at = [(i, k) for k, p in licenses.BASE_PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        want.append(key(d, len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(sorted({k for _, k in at}))))
    assert brute.bag(key(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == brute.bag(want)
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)
    assert licenses.scan_licenses(frame(spark, [])).count() == 0


def test_license_spans_bear_edits(spark):
    text = "aa bb. Permission is hereby granted, free of charge, to ANY nice person obtaining a copy of this software and associated documentation files cc"
    r = licenses.scan_licenses(frame(spark, [(1, text), (2, "permission is hereby granted to sing")])).orderBy("doc_id").collect()
    assert r[0].labels == "mit-notice" and (r[0].spans[0].lo, r[0].spans[0].hi) == (2, 22) and r[1].labels == ""


def item_rows(rng):
    word = lambda: rng.choice(["the", "of", "and"]) if rng.random() < 0.4 else f"word{rng.randrange(400)}"
    return [(i, " ".join(word() for _ in range(rng.randrange(8, 40)))) for i in range(8)] + [(20, "one two three"), (21, "solo"), (22, ""), (23, None), (24, "one two three")]


def test_leaks_equal_brute_force(spark):
    rng = random.Random(6)
    items = item_rows(rng)
    docs = []
    for i in range(60):
        w = [f"word{rng.randrange(400)}" for _ in range(rng.randrange(0, 60))]
        if i % 2:
            v = items[i % 8][1].split()
            for _ in range(rng.randrange(0, 5)):
                v[rng.randrange(len(v))] = "edit"
            if i % 5 == 0:
                v.insert(len(v) // 2, "extra")
            w[len(w) // 2 : len(w) // 2] = v
        docs.append((i, " ".join(w).upper() if i % 3 else ", ".join(w)))
    docs += [(100, None), (101, ""), (102, "zz one, TWO three zz"), (103, "solo"), (None, items[0][1]), (104, items[1][1]), (104, items[1][1])]
    got = decontam.find_leaks(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == brute.leaks(docs, [x for x in items if x[0] != 24])
    clean = decontam.without_leaks(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    bad = {d for d, _ in brute.leaks(docs, items)}
    assert sorted(r.doc_id for r in clean.collect()) == sorted(d for d, _ in docs if d not in bad) and clean.columns == ["doc_id", "text", "tid", "label"]


def all_windows(docs, items, k=5, num=4, den=5):
    """{(doc_id, item_id): (similarity, places, first word)} over every window of the item's size, wherever it starts."""

    def weighted(w):
        n = min(k, len(w))
        return {tuple(w[i : i + n]): 1 + sum(len(x) >= 4 for x in w[i : i + n]) for i in range(len(w) - n + 1)} if w else {}

    out = {}
    for d, t in docs:
        w = brute.plain_words(t)
        for i, x in items:
            v = brute.plain_words(x)
            b, rates = weighted(v), {}
            for s in range(max(1, len(w) - len(v) + 1)):
                a = weighted(w[s : s + len(v)])
                both, joint = sum(c for y, c in a.items() if y in b), sum({**a, **b}.values())
                if both and den * both >= num * joint:
                    rates[s] = round(both / joint, 6)
            firsts = [s for s in sorted(rates) if s - 1 not in rates]
            if firsts:
                run = [s for s in sorted(rates) if all(z in rates for z in range(firsts[0], s))]
                out[d, i] = (max(rates.values()), len(firsts), max(run, key=lambda s: (rates[s], -s)))
    return out


def test_leaks_of_every_window_equal_brute_force(spark):
    """Halves of an item the other way round share no diagonal with it, but most shingles."""
    rng = random.Random(9)
    item = [f"word{i}" for i in range(60)]
    pad = lambda n: [f"pad{rng.randrange(9999)}" for _ in range(n)]
    turned = item[30:] + item[:30]
    docs = [(0, pad(80) + turned + pad(80)), (1, turned), (2, pad(9) + item + pad(40) + turned + pad(3)), (3, pad(20) + item[:30] + pad(2) + item[30:] + pad(20)), (4, item[:50]), (5, item * 3)]
    docs += [(6 + c, pad(30) + item[c:] + item[:c] + pad(30)) for c in range(0, 60, 7)]
    docs += [(20 + c, pad(10) + item[20:40] + item[:20] + item[40 : 40 + c] + pad(10)) for c in range(0, 21, 4)]
    docs = [(d, " ".join(w)) for d, w in docs] + [(50, "the of the of the of the of the"), (51, "solo word1 solo solo"), (52, None), (53, "")]
    items = [(1, " ".join(item)), (2, "the of the of the of"), (3, "solo"), (4, " ".join(item[:12] + item[6:18]))]
    got = decontam.find_leaks(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = all_windows(docs, items)
    assert {(r.doc_id, r.item_id): (r.similarity, r.n_places, r.first_word) for r in got} == want and len(got) == len(want)
    assert (0, 1) in want and (0, 1) not in brute.leaks(docs, items)


def test_large_benchmarks_go_in_blocks(spark, monkeypatch):
    items = spark.createDataFrame(item_rows(random.Random(6)), "item_id long, text string")
    docs = frame(spark, [(i, t) for i, t in item_rows(random.Random(6))])
    whole = brute.bag((r.doc_id, r.item_id) for r in decontam.find_leaks(docs, items).collect())
    monkeypatch.setattr(decontam, "BLOCK_GRAMS", 20)
    assert brute.bag((r.doc_id, r.item_id) for r in decontam.find_leaks(docs, items).collect()) == whole and len(whole) >= 10


def test_leaks_of_empty_tables(spark):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontam.find_leaks(frame(spark, ODD), empty).count() == 0
    assert decontam.find_leaks(frame(spark, []), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.binary(min_size=1, max_size=5000))
def test_gif_round_trip(data):
    import numpy as np

    payload = np.frombuffer(data + b"\xff" * (-len(data) % gifmedia.PIXELS), np.uint8)
    raw = gifmedia.encode(payload)
    frames = list(gifmedia.decode(raw))
    assert b"".join(f.indices.tobytes() for f in frames) == payload.tobytes()
    assert all(f.delay_ms == 40 and f.rgba.shape == (24, 24, 4) and (f.rgba[..., 0] == f.indices).all() for f in frames)


def lzw(pixels, first_width, defer=False):
    """A plain compressor with growing code widths, for the decoder's test; with `defer` it goes on with the full table."""
    clear, bits, n = 1 << first_width, 0, 0
    out, table, width, nxt, prev = [], {}, first_width + 1, clear + 2, ()

    def emit(code):
        nonlocal bits, n
        bits |= code << n
        n += width

    emit(clear)
    table = {(i,): i for i in range(clear)}
    for x in pixels:
        if prev + (x,) in table:
            prev += (x,)
            continue
        emit(table[prev])
        if nxt < 4096:
            table[prev + (x,)] = nxt
            if nxt == 1 << width and width < 12:
                width += 1
            nxt += 1
        elif not defer:
            emit(clear)
            table, width, nxt = {(i,): i for i in range(clear)}, first_width + 1, clear + 2
        prev = (x,)
    emit(table[prev])
    emit(clear + 1)
    return bits.to_bytes(-(-n // 8), "little")


def test_lzw_with_growing_widths():
    rng = random.Random(8)
    for first, size in [(2, 50), (4, 3000), (8, 20000), (8, 90000)]:
        pixels = [rng.randrange(1 << first) if rng.random() < 0.5 else 1 for _ in range(size)]
        for defer in (False, True):
            assert list(gifmedia.lzw_decode(lzw(pixels, first, defer), first, size)) == pixels
        assert gifmedia.pack_codes([gifmedia.lzw_encode(bytes(pixels), first)] * 2, first)[1] == lzw(pixels, first) or size > 4000
        assert list(gifmedia.lzw_decode(gifmedia.pack_codes([gifmedia.lzw_encode(bytes(pixels), first)], first)[0], first, size)) == pixels


def test_pictures_in_lock_step_equal_the_plain_coder():
    import numpy as np

    rng = np.random.default_rng(3)
    for size in (1, 2, 40, 576, 900):
        rows = np.concatenate([rng.integers(0, 256, (5, size)), rng.integers(97, 100, (20, size)), np.full((2, size), 7)]).astype(np.uint8)
        streams = gifmedia.encode_pictures(rows)
        assert streams == gifmedia.pack_codes([gifmedia.lzw_encode(r.tobytes()) for r in rows])
        odd = [streams[0][:-3], b"", streams[1], b"\x00\x01\x02" * 9]
        for s, x in zip(streams + odd[:3:2], gifmedia.decode_pictures(streams + odd[:3:2], size), strict=True):
            assert (x == gifmedia.lzw_decode(s, 8, size)).all()
        assert (np.array(gifmedia.decode_pictures(streams, size)) == rows).all()
    assert gifmedia.decode_pictures([], 4) == [] and (gifmedia.decode_pictures([b""], 4)[0] == 0).all()


def gif(pictures, w=4, h=4):
    """A GIF of (left, top, width, height, pixels, disposal, transparent, interlaced) pictures with a four-colour palette."""
    import struct

    out = b"GIF89a" + struct.pack("<HHBBB", w, h, 0x91, 0, 0) + bytes([255, 0, 0, 0, 255, 0, 0, 0, 255, 9, 9, 9])
    for left, top, pw, ph, pixels, disposal, clear, interlaced in pictures:
        out += b"\x21\xf9\x04" + struct.pack("<BHB", disposal << 2 | (clear is not None), 5, clear or 0) + b"\0"
        data = lzw(pixels, 2)
        out += b"\x2c" + struct.pack("<HHHHB", left, top, pw, ph, 0x40 * interlaced) + b"\x02" + bytes([len(data)]) + data + b"\0"
    return out + b"\x21\xfe\x02hi\0\x3b"


def test_disposal_transparency_and_interlacing(spark):
    full = (0, 0, 4, 4, [0] * 16, 1, None, 0)
    frames = list(gifmedia.decode(gif([full, (1, 1, 2, 2, [1, 3, 3, 1], 2, 3, 0), (0, 0, 1, 1, [2], 3, None, 0), (3, 3, 1, 1, [1], 1, None, 0)])))
    red, green, blue = [255, 0, 0, 255], [0, 255, 0, 255], [0, 0, 255, 255]
    assert frames[1].rgba[1, 1].tolist() == green and frames[1].rgba[1, 2].tolist() == red
    assert frames[2].rgba[1, 1].tolist() == [0, 0, 0, 0] and frames[2].rgba[0, 0].tolist() == blue
    assert frames[3].rgba[0, 0].tolist() == red and frames[3].rgba[3, 3].tolist() == green
    rows = [i for i in range(4) for _ in range(4)]
    order = [rows[0:4], rows[8:12], rows[4:8], rows[12:16]]
    assert list(gifmedia.decode(gif([(0, 0, 4, 4, sum(order, []), 0, None, 1)])))[0].indices[:, 0].tolist() == [0, 1, 2, 3]
    media = spark.createDataFrame([(1, bytearray(gif([full, full]))), (2, None), (3, bytearray(b"GIF89abroken"))], "doc_id long, media binary")
    got = gifmedia.gif_frames(media).orderBy("doc_id", "frame").collect()
    assert [(r.doc_id, r.frame, r.start_ms, r.delay_ms) for r in got if r.error is None] == [(1, 0, 0, 50), (1, 1, 50, 50)]
    assert sum(got[0].histogram if got[0].histogram else got[1].histogram) == 16 and any(r.doc_id == 3 and r.error for r in got)


@pytest.mark.parametrize("width", [0, 12, 63, 64, 200, 255])
def test_bad_code_sizes_and_huge_screens_give_an_error_row(spark, width):
    good = gif([(0, 0, 4, 4, [0] * 16, 1, None, 0)])
    at = good.index(b"\x2c") + 10
    bad = good[:at] + bytes([width]) + good[at + 1 :]
    huge = b"GIF89a" + b"\xff\xff\xff\xff" + good[10:]
    rows = gifmedia.gif_frames(spark.createDataFrame([(1, bytearray(bad)), (2, bytearray(huge)), (3, bytearray(good)), (4, bytearray(good[: at + 2]))], "doc_id long, media binary")).collect()
    assert {r.doc_id for r in rows if r.error} >= {1, 2} and [r.frame for r in rows if r.doc_id == 3] == [0]


def test_digest_equals_plain_python(spark):
    import hashlib
    import zlib

    rows = [(1, None), (2, ""), (3, "a" * 576), (4, "the quick brown fox " * 99), (5, "é\0ü\n" * 700), (6, "x" * 577)]
    got = {r.doc_id: r for r in gifmedia.media_digest(gifmedia.store_texts(frame(spark, rows))).collect()}
    for d, t in rows:
        raw = (t or "").encode()
        payload = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        bins = [0] * 64
        for x in payload:
            bins[(x >> 6) * 21] += 1
        r = got[d]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert r.feature == f"frames={len(payload) // 576};ms={len(payload) // 576 * 40};hist=" + ",".join(f"{i}:{n}" for i, n in enumerate(bins) if n)


def test_stored_texts(spark):
    got = {r.doc_id: r for r in gifmedia.media_digest(gifmedia.store_texts(frame(spark, ODD[:3] + [(9, "é" * 300)]))).collect()}
    assert got[1].payload_bytes == 576 and got[1].n_bytes == 0 and got[1].media_sha256 == got[2].media_sha256 and got[9].payload_bytes == 1152
    assert gifmedia.media_digest(gifmedia.store_texts(frame(spark, []))).count() == 0


def test_screen_loses_no_key_and_stops_most_other_texts(spark, monkeypatch):
    texts = spark.range(4000).select(F.xxhash64("id").alias("text_hash"), F.col("id").alias("row"))
    keys = texts.where("row % 40 = 0").union(texts.where("row = 0")).select("text_hash")
    got = {r.row for r in decontam.screened(texts, keys).collect()}
    assert {i for i in range(4000) if i % 40 == 0} <= got and len(got) < 110
    assert decontam.screened(texts, keys).columns == ["text_hash", "row"]
    assert decontam.screened(texts, keys.where("false")).count() == 0
    monkeypatch.setattr(decontam, "SCREEN_BITS", 64)  # full: every text passes, once each
    assert decontam.screened(texts, texts.select("text_hash")).count() == 4000


def test_windows_of_a_run_share_their_shingles(spark):
    """Each window has the shingles of its own words, and they are made below the rows of the starts: before, once for each window."""
    w = [f"word{i % 7} of{i % 3}" for i in range(60)]
    w = " ".join(w).split()
    rows = [(1, 9, 0, 90, w), (2, 9, 40, 40, w), (3, 3, 5, 11, w), (4, 12, 0, 0, w[:8]), (5, 12, 0, 0, w[:2]), (6, 120, 0, 0, w), (7, 5, 0, 2, w[:7])]
    runs = spark.createDataFrame(rows, "row int, m int, lo long, hi long, w array<string>")
    got = decontam.window_shingles(runs, 5)
    alone = runs.select("row", "m", "w", F.explode(F.sequence("lo", "hi")).alias("start"))
    want = alone.select("row", "m", "start", decontam.weighted_shingles(F.slice("w", (F.col("start") + 1).cast("int"), F.col("m")), 5).alias("ws"))
    assert got.columns == want.columns
    plain = lambda df: sorted((r.row, r.m, r.start, sorted(map(tuple, r.ws))) for r in df.collect())
    assert plain(got) == plain(want) and got.count() == 91 + 1 + 7 + 1 + 1 + 1 + 3
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("array_join")


def test_license_labels_equal_all_windows(spark):
    """Labels and scores of pieces of notices with words changed, dropped, repeated and put in, and of a notice behind many of its own openings."""
    rng = random.Random(12)
    notices = list(licenses.NOTICES.values())
    texts = ["licensed under the " * 12 + licenses.NOTICES["apache-2-notice"], "licensed under the " * 40, licenses.NOTICES["bsd"] + " " + licenses.NOTICES["bsd"]]
    for _ in range(80):
        w = []
        for _ in range(rng.randrange(1, 4)):
            t = rng.choice(notices + list(licenses.BASE_PHRASES.values())).split()
            a = rng.randrange(len(t))
            part = t[a : a + rng.randrange(3, 30)] if rng.random() < 0.4 else list(t)
            for _ in range(rng.randrange(3)):
                x = rng.randrange(len(part))
                part[x : x + rng.randrange(2)] = [rng.choice(["the", "and", "other"])] * rng.randrange(3)
            w += part * rng.randrange(1, 3) + ["filler"] * rng.randrange(6)
        texts.append(" ".join(w))
    rows = list(enumerate(texts))
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan_licenses(frame(spark, rows)).collect()}
    assert got == {i: brute.license_labels(t, licenses.BASE_PHRASES, licenses.NOTICES) for i, t in rows}
    assert "apache-2-notice" in got[0][0]


def test_null_and_broken_media(spark):
    good = gifmedia.encode((np.arange(576) % 256).astype(np.uint8))
    rows = [(1, 3, good), (2, 3, None), (3, 3, b"GIF89a"), (4, 3, b"")]
    got = {r.doc_id: r for r in gifmedia.media_digest(spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary")).collect()}
    assert got[1].error is None and got[1].payload_bytes == 576
    assert got[2].media_bytes is None and got[2].error is None
    assert all(got[i].error and got[i].payload_sha256 is None for i in (3, 4)) and got[3].media_bytes == 6
