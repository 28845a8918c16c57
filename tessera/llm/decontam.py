"""Benchmark decontamination by SimHash windows, in Spark SQL expressions only.

A window of an item's size can only be similar to any item of that size if those of its
shingles that the items of the size hold weigh the threshold's part of the lightest one. So
the shingles of all texts meet the joint set of the items' shingles, and running sums over
the starts tell which windows of each size get a fingerprint; no other window can pass.

Which item a window resembles is found by fingerprints alone: 64-bit SimHashes of windows and
items of one size are cut into one block more than the radius has bits, so two within the
radius agree in a block, and blocks meet in an equi-join. A pair counts in its first common
block. What is within the radius is decided by the exact weighted similarity.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.licenses import words
from tessera.llm.linear import free_prefix
from tessera.session import materialize

#: Items' shingles that are broadcast at a time; a larger benchmark goes over the texts in as many blocks as it needs.
BLOCK_GRAMS = 1_000_000
BITS = 64
#: Bits of the screen of text hashes that is broadcast: 8 MB at any size of the input.
SCREEN_BITS = 1 << 26
#: Neighbouring windows whose shingles are made together.
STRETCH = 32


def grams(w: Column, k: int) -> Column:
    return F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*(w[i + j] for j in range(k))))).otherwise(
        F.array().cast("array<bigint>")
    )


def shingle_weight(part: Column) -> Column:
    """A shingle weighs 1 and 1 more for each of its words of four or more letters, so runs of function words count little."""
    return (F.lit(1) + F.size(F.filter(part, lambda x: F.length(x) >= 4))).cast("long")


def placed_shingles(w: Column, n: Column) -> Column:
    """(hash, weight) of the n words from each place on, in order."""

    def one(i: Column) -> Column:
        part = F.slice(w, i + 1, n)
        return F.struct(F.xxhash64(F.array_join(part, " ")).alias("h"), shingle_weight(part).alias("v"))

    return F.transform(F.sequence(F.lit(0), F.size(w) - n), one)


def weighted_shingles(w: Column, k: int) -> Column:
    """Distinct (hash, weight) of the shingles of k words, or of the whole if shorter."""
    return F.when(F.size(w) > 0, F.array_distinct(placed_shingles(w, F.least(F.lit(k), F.size(w)))))


def window_shingles(runs: DataFrame, k: int) -> DataFrame:
    """Of runs lo..hi of windows of m words of w: a row for each start, with the window's weighted shingles ws in place of w, lo and hi.

    Windows of a run overlap, so the shingles of STRETCH neighbours are made once, for the words they cover together.
    """
    kept = [c for c in runs.columns if c not in ("w", "lo", "hi")]
    some = runs.select(*kept, "w", "hi", F.explode(F.sequence("lo", "hi", F.lit(STRETCH).cast("long"))).alias("lo"))
    some = some.withColumn("hi", F.least("hi", F.col("lo") + STRETCH - 1))
    some = some.select(*kept, "lo", "hi", F.slice("w", (F.col("lo") + 1).cast("int"), (F.col("hi") - F.col("lo") + F.col("m")).cast("int")).alias("part"))
    # All windows of a text are of one length, its own if it is shorter than the item.
    length = F.least(F.col("m"), F.size("part"))
    size = F.least(F.lit(k), length)
    some = some.select(*kept, "lo", "hi", (length - size + 1).alias("n"), F.when(F.size("part") > 0, placed_shingles(F.col("part"), size)).alias("all"))
    starts = some.select(*kept, "lo", "n", "all", F.explode(F.sequence("lo", "hi")).alias("start"))
    return starts.select(*kept, "start", F.array_distinct(F.slice("all", (F.col("start") - F.col("lo") + 1).cast("int"), F.col("n"))).alias("ws"))


def simhash(shingles: Column) -> Column:
    """64 bits: each the sign of the weights of the shingles that have it, less those that have not."""
    zero = F.lit(0).cast("long")

    def bit(b: int) -> Column:
        votes = F.aggregate(shingles, zero, lambda acc, s: acc + F.when(F.getbit(s["h"], F.lit(b)) == 1, s["v"]).otherwise(-s["v"]))
        return F.when(votes > 0, F.shiftleft(F.lit(1).cast("long"), b)).otherwise(zero)

    return reduce(lambda x, y: x.bitwiseOR(y), [bit(b) for b in range(BITS)])


def _cuts(radius: int) -> list[tuple[int, int]]:
    edges = [BITS * i // (radius + 1) for i in range(radius + 2)]
    return list(zip(edges[:-1], edges[1:], strict=True))


def _cut(print_: Column, a: int, b: int) -> Column:
    return F.shiftrightunsigned(print_, a).bitwiseAND(F.lit((1 << (b - a)) - 1 if b - a < 63 else -1).cast("long"))


def blocks(print_: Column, radius: int) -> Column:
    """radius + 1 numbered blocks (i, x) of a fingerprint."""
    return F.array(*(F.struct(F.lit(i).alias("i"), _cut(print_, a, b).alias("x")) for i, (a, b) in enumerate(_cuts(radius))))


def first_common(x: Column, y: Column, radius: int) -> Column:
    """The number of the first block in which two fingerprints agree; null if they agree in none."""
    apart = x.bitwiseXOR(y)
    return F.coalesce(*(F.when(_cut(apart, a, b) == 0, i) for i, (a, b) in enumerate(_cuts(radius))))


def weight(shingles: Column) -> Column:
    return F.aggregate(shingles, F.lit(0).cast("long"), lambda acc, s: acc + s["v"])


def screened(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """The texts whose text_hash may be among the keys: none that is gets lost, and of the others the part of the screen's bits that are set passes.

    The screen is a bitmap of a fixed size, so a join with the keys exchanges few other texts until the keys fill it.
    """
    place = lambda: F.pmod(F.col("text_hash"), F.lit(SCREEN_BITS))
    spread = keys.select("text_hash").distinct().select(F.bitmap_bucket_number(place()).alias("bucket"), F.bitmap_bit_position(place()).alias("bit"))
    # Dealt by bucket first: partial bitmaps of every task would be exchanged otherwise.
    maps = spread.repartition("bucket").groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bitmap"))
    bit = F.bitmap_bit_position(place())
    byte = F.conv(F.hex(F.substring("bitmap", (F.floor(bit / 8) + 1).cast("int"), 1)), 16, 10).cast("int")
    held = texts.join(F.broadcast(maps), F.bitmap_bucket_number(place()) == F.col("bucket"))
    return held.where(F.getbit(byte, (bit % 8).cast("int")) == 1).drop("bucket", "bitmap")


def find_leaks(docs: DataFrame, benchmark: DataFrame, k: int = 5, num: int = 4, den: int = 5, radius: int = 20) -> DataFrame:
    """doc_id, text_hash, item_id, similarity, n_places, first_word of every text and item that meet.

    Both are words of ASCII letters, digits and non-ASCII characters, A-Z folded. An item meets
    a text if any window of its size has den * common weight >= num * joint weight of the
    distinct shingles of k words; items of fewer words are one shingle. Windows that start at
    neighbouring words are one place; first_word is the start of the most similar window of the
    first place. At the threshold, fingerprints differ in about ten bits with a deviation of
    about three, so a radius of 20 loses about one in 5000 of the pairs right at it. Items of equal words are one item, the smallest item_id; null
    texts and items without words meet nothing. Repeated rows are listed once each; null ids are
    kept. A text shorter than an item is one window. Other columns are not read.
    """
    item = benchmark.select("item_id", words(F.col("text")).alias("iw")).where(F.size("iw") > 0)
    item = item.groupBy("iw").agg(F.min("item_id").alias("item_id")).withColumn("no", F.monotonically_increasing_id())
    items = materialize(item.withColumn("m", F.size("iw")).withColumn("kk", F.least(F.lit(k), F.size("iw"))), "items")
    lengths = sorted(r.kk for r in items.select("kk").distinct().collect())  # at most k values
    total = items.agg(F.sum(F.col("m") - F.col("kk") + 1)).first()[0] or 0
    n_blocks = max(1, -(-total // BLOCK_GRAMS))
    texts = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("text").alias("text_hash"), "text")
    if not lengths:
        return texts.where("false").select("doc_id", "text_hash", F.lit(0).cast("long").alias("item_id"), F.lit(0.0).alias("similarity"), F.lit(0).cast("long").alias("n_places"), F.lit(0).cast("long").alias("first_word"))
    hits = []
    for n in lengths:
        parts = items.where(F.col("kk") == n).withColumn("least", weight(weighted_shingles(F.col("iw"), k)) * num).select("m", "least", "iw", F.posexplode(grams(F.col("iw"), n)).alias("q", "g"))
        parts = parts.withColumn("v", shingle_weight(F.slice("iw", F.col("q") + 1, F.lit(n)))).groupBy("m", "g").agg(F.max("v").alias("v"), F.min("least").alias("least"))
        least = parts.groupBy("m").agg(F.min("least").alias("least"))
        parts = parts.drop("least").join(least, "m")
        # The row's number keeps Spark from moving a test of tg below the split into words, which it would then repeat for every shingle.
        placed = docs.select(F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("w"))
        placed = placed.withColumns({"tg": grams(F.col("w"), n), "row": F.monotonically_increasing_id()}).where("row >= 0").select("text_hash", F.size("w").alias("n"), F.posexplode("tg").alias("p", "g"))
        for b in range(n_blocks):
            block = F.broadcast(parts.where(F.pmod(F.xxhash64("g"), F.lit(n_blocks)) == b))
            # The first and the last window that hold this shingle.
            first, last = F.greatest(F.col("p") + n - F.col("m"), F.lit(0)), F.greatest(F.least(F.col("p"), F.col("n") - F.col("m")), F.lit(0))
            hits.append(placed.join(block, "g").select("text_hash", "m", "least", "p", "v", first.alias("lo"), last.alias("hi")))
    # Repeated texts count once; texts of equal hashes can only add windows, which the exact similarity decides.
    sized = ["text_hash", "m", "least"]
    found = reduce(DataFrame.unionAll, hits).repartition("text_hash", "m").distinct()
    ends = F.array(F.struct(F.col("lo").alias("at"), F.col("v").alias("d")), F.struct((F.col("hi") + 1).alias("at"), (-F.col("v")).alias("d")))
    steps = found.select(*sized, F.inline(ends)).groupBy(*sized, "at").agg(F.sum("d").alias("d"))
    by_start = W.partitionBy("text_hash", "m").orderBy("at")
    sums = steps.withColumn("both", F.sum("d").over(by_start.rowsBetween(W.unboundedPreceding, 0))).withColumn("to", F.lead("at").over(by_start))
    runs = materialize(sums.where((F.col("both") > 0) & (F.col("both") * den >= F.col("least"))).select("text_hash", "m", F.col("at").alias("lo"), (F.col("to") - 1).alias("hi")), "runs")
    windows = screened(texts, runs).join(runs, "text_hash").select("row", "doc_id", "text_hash", "m", "lo", "hi", words(F.col("text")).alias("w"))
    # Cut here, so that the arrays are computed once for each window.
    windows = materialize(window_shingles(windows, k), "windows")
    known = materialize(items.select("m", "item_id", weighted_shingles(F.col("iw"), k).alias("is")), "shingles")
    prints = lambda df, c, o: materialize(df.withColumn(o, simhash(F.col(c))), "prints")
    indexed = lambda df, o: df.select("*", F.inline(blocks(F.col(o), radius)))
    pairs = indexed(prints(windows, "ws", "wf"), "wf").join(indexed(prints(known, "is", "if"), "if"), ["m", "i", "x"])
    near = pairs.where((first_common(F.col("wf"), F.col("if"), radius) == F.col("i")) & (F.bit_count(F.col("wf").bitwiseXOR(F.col("if"))) <= radius))
    common = near.withColumn("both", weight(F.array_intersect("ws", "is"))).withColumn("joint", weight(F.array_union("ws", "is")))
    similar = common.where(F.col("both") * den >= F.col("joint") * num).withColumn("similarity", F.round(F.col("both") / F.col("joint"), 6))
    one = ["row", "doc_id", "text_hash", "item_id"]
    starts = W.partitionBy("row", "item_id").orderBy("start")
    places = similar.withColumn("place", F.col("start") - F.row_number().over(starts)).groupBy(*one, "place").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"))).alias("best"))
    first = F.min(F.struct("place", (-F.col("best.back")).alias("start")))["start"]
    return places.groupBy(*one).agg(F.max("best.similarity").alias("similarity"), F.count("*").alias("n_places"), first.cast("long").alias("first_word")).drop("row")


def without_leaks(docs: DataFrame, benchmark: DataFrame, **options: int) -> DataFrame:
    """The rows of documents whose text meets no item, with all their columns, whatever their names and types. Null, empty and repeated rows stay as they are judged."""
    p = free_prefix(docs)
    bad = find_leaks(docs, benchmark, **options).select(F.col("doc_id").alias(p + "id"), F.col("text_hash").alias(p + "hash")).distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col(p + "id")) & (F.xxhash64("text") == F.col(p + "hash")), "left_anti")
