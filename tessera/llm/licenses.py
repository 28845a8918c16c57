"""License scans by diagonal voting, in Spark SQL expressions only.

All rolling k-word grams of every text are joined by hash with the gram positions of the
license templates. Matches vote for the diagonal (text position minus template position);
neighbouring diagonals are merged, so that inserted or dropped words cost little, and in what
was merged the best window of the template's length decides by the share of its grams.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The phrases whose exact places are counted, by label.
BASE_PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
#: Well-known notice lines and openings that are matched approximately.
NOTICES = {
    "agpl-3": "licensed under the gnu affero general public license version 3",
    "apache-2-notice": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "cc-by": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-sa": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "gpl-3": "this work is licensed under the gnu general public license version 3",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "lgpl-3": "licensed under the gnu lesser general public license version 3",
    "mit-notice": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "mpl-2": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "unlicense": "this is free and unencumbered software released into the public domain",
}
#: Words after lower-casing A-Z: runs of ASCII letters, digits and non-ASCII characters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
MARK = 0x7E55E7A


def words(text: Column) -> Column:
    """Words of a text (null: none). The Kelvin sign is replaced first: lower() alone would make an ASCII k of it."""
    # A split takes a third of the time of extracting all matches.
    return F.array_remove(F.split(F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("κ"))), BETWEEN), "")


def _grams(w: Column, k: int) -> Column:
    return F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*(w[i + j] for j in range(k))))).otherwise(
        F.array().cast("array<bigint>")
    )


def _templates(spark: SparkSession, base: dict[str, str], notices: dict[str, str], k: int) -> DataFrame:
    """tid, label, base, n_grams, t_words, hash, tpos, gram; and the mark that keeps one row of every text."""
    rows = [F.struct(F.lit(i).alias("tid"), F.lit(label).alias("label"), F.lit(b).alias("base"), F.array(*map(F.lit, text.split())).alias("w")) for i, (label, text, b) in enumerate([(x, t, True) for x, t in base.items()] + [(x, t, False) for x, t in notices.items()])]
    t = spark.range(1).select(F.inline(F.array(*rows)))
    grams = t.select("tid", "label", "base", (F.size("w") - (k - 1)).alias("n_grams"), F.size("w").alias("t_words"), "w", F.posexplode(_grams(F.col("w"), k)).alias("tpos", "hash"))
    grams = grams.withColumn("gram", F.slice("w", F.col("tpos") + 1, k)).drop("w")
    mark = spark.range(1).select(
        F.lit(-1).alias("tid"), F.lit(None).cast("string").alias("label"), F.lit(False).alias("base"), F.lit(1).alias("n_grams"), F.lit(0).alias("t_words"),
        F.lit(0).alias("tpos"), F.lit(MARK).cast("bigint").alias("hash"), F.lit(None).cast("array<string>").alias("gram"),
    )
    return grams.unionByName(mark)


def _best_window(runs: Column, wide: Column, lo: Column, hi: Column) -> Column:
    """n, lo, hi: the most different grams that lie within `wide` words of each other, and the first and last word of the first such place.

    runs: (diag, tps) of a cluster. One that is no wider counts whole; in any other a window goes over its matches.
    """
    grams = lambda x: F.array_distinct(F.transform(x, lambda h: h["tpos"]))
    hits = F.array_sort(F.flatten(F.transform(runs, lambda r: F.transform(r["tps"], lambda t: F.struct((r["diag"] + t).cast("bigint").alias("pos"), t.cast("int").alias("tpos"))))))
    none = F.array().cast("array<struct<pos:bigint,tpos:int>>")
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).cast("bigint").alias("lo"), F.lit(0).cast("bigint").alias("hi"), none.alias("held"))

    def step(best: Column, h: Column) -> Column:
        held = F.concat(F.filter(best["held"], lambda x: x["pos"] >= h["pos"] - wide), F.array(h))
        more = F.size(grams(held)) > best["n"]
        pick = lambda new, old: F.when(more, new).otherwise(best[old]).alias(old)
        return F.struct(pick(F.size(grams(held)), "n"), pick(held[0]["pos"], "lo"), pick(h["pos"], "hi"), held.alias("held"))

    searched = F.aggregate(hits, zero, step, lambda b: F.struct(b["n"].alias("n"), b["lo"].alias("lo"), b["hi"].alias("hi")))
    whole = F.struct(F.size(grams(hits)).alias("n"), lo.cast("bigint").alias("lo"), hi.cast("bigint").alias("hi"))
    return F.when(hi - lo <= wide, whole).otherwise(searched)


def scan_licenses(docs: DataFrame, base: dict[str, str] | None = None, notices: dict[str, str] | None = None, k: int = 3, gap: int = 3, coverage: float = 0.7) -> DataFrame:
    """Per row of doc_id, text: n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    A base phrase must stand word by word; every place counts, also overlapping ones. Of
    each template, matches on diagonals at most `gap` apart form a cluster; the words of a cluster, no
    more than twice the template's length apart, that cover most of its grams are reported if they
    cover at least `coverage` of them. score is the best coverage. spans holds (label, first, last,
    coverage). Null or empty text: no words, empty labels, score 0. Equal rows give equal
    results; a null doc_id is kept; other columns are not read. Templates must have k words.
    """
    base, notices = BASE_PHRASES if base is None else base, NOTICES if notices is None else notices
    if short := [t for t in [*base.values(), *notices.values()] if len(t.split()) < k]:
        raise ValueError(f"templates shorter than {k} words: {short}")
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), words(F.col("text")).alias("w"))
    placed = texts.select("row", "doc_id", F.size("w").cast("long").alias("n_words"), "w", F.posexplode(F.concat(F.array(F.lit(MARK).cast("bigint")), _grams(F.col("w"), k))).alias("at", "hash"))
    t = _templates(docs.sparkSession, base, notices, k)
    grams = sum(len(x.split()) for x in [*base.values(), *notices.values()])
    t = F.broadcast(t) if grams <= 1_000_000 else t  # templates are a parameter, not data
    hits = (
        placed.join(t, "hash")
        .where(F.when(F.col("tid") < 0, F.col("at") == 0).otherwise((F.col("at") > 0) & (F.slice("w", F.greatest(F.col("at"), F.lit(1)), k) == F.col("gram"))))
        .select("row", "doc_id", "n_words", "tid", "label", "base", "n_grams", "t_words", "tpos", (F.col("at") - 1).cast("long").alias("pos"))
        .repartition("row", "doc_id")
    )
    text, span = ["row", "doc_id"], ["row", "doc_id", "tid"]
    diagonal = hits.groupBy(*span, "label", "base", "n_grams", "t_words", (F.col("pos") - F.col("tpos")).alias("diag")).agg(
        F.max("n_words").alias("n_words"), F.collect_set("tpos").alias("tps"), F.min("pos").alias("lo"), F.max("pos").alias("hi")
    )
    by = W.partitionBy(*span).orderBy("diag")
    opened = diagonal.withColumn("new", F.coalesce((F.col("diag") - F.lag("diag").over(by) > gap).cast("int"), F.lit(0)))
    merged = opened.withColumn("cluster", F.sum("new").over(by.rowsBetween(W.unboundedPreceding, 0)))
    exact = F.col("base") & (F.size("tps") == F.col("n_grams"))
    spans = (
        merged.groupBy(*span, "label", "base", "n_grams", "t_words", "cluster")
        .agg(
            F.max("n_words").alias("n_words"),
            F.count(F.when(exact, 1)).alias("places"),
            F.min(F.when(exact, F.col("diag"))).alias("p0"),
            F.max(F.when(exact, F.col("diag"))).alias("p1"),
            F.min("lo").alias("lo"),
            F.max("hi").alias("hi"),
            F.collect_list(F.struct("diag", "tps")).alias("runs"),
        )
        .withColumn("best", _best_window(F.col("runs"), 2 * F.col("t_words") - k, F.col("lo"), F.col("hi")))
        .withColumns({"lo": F.col("best.lo"), "hi": F.col("best.hi") + (k - 1)})
        .withColumn("cov", F.when(F.col("tid") < 0, 0.0).otherwise(F.round(F.col("best.n") / F.col("n_grams"), 6)))
        .withColumn("ok", (F.col("tid") >= 0) & ~F.col("base") & (F.col("cov") >= coverage))
        .drop("runs", "best")
    )
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    held = F.col("places") > 0
    return spans.groupBy(*text).agg(
        F.max("n_words").alias("n_words"),
        F.sum("places").alias("n_base"),
        F.min("p0").alias("first_word"),
        F.max("p1").alias("last_word"),
        joined(F.when(held, F.col("label"))).alias("base_labels"),
        joined(F.when(held | F.col("ok"), F.col("label"))).alias("labels"),
        F.max("cov").alias("score"),
        F.array_sort(F.collect_list(F.when(held | F.col("ok"), F.struct("lo", "hi", "label", "cov")))).alias("spans"),
    ).drop("row")
