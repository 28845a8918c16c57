"""The engine's queries over the test tables, each with the same computation in SQL.

Roles: documents are chunks (lang the product, source the module), embeddings the vectors
(vec_id = doc_id), benchmark the queries (whole texts; vector of vec_id = item_id),
labels the grades, events the latencies and routes, conversations the usage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.config import MODES, STOPWORDS, RetrievalConfig
from tessera.functions import text as tx
from tessera.operators import bm25 as kw
from tessera.operators import catalog, evals, fusion
from tessera.operators.chunking import html_blocks, pack_chunks, page_facts, text_blocks
from tessera.operators.keyword_index import KeywordIndex
from tessera.operators.retrieve import KnowledgeBase, retrieve, retrieve_modes
from tessera.operators.vector import cosine_search
from tessera.operators.vector_store import VectorStore
from tessera.plans.loop import tool_loop, widening_router
from tessera.session import materialize, scratch_path, scratch_root
from tessera.sources.fetch import crawl, expand_modes
from tessera.sources.fetch import semantic_units as fetch_units
from tessera.sources.tables import table
from tessera.streaming.bucket_store import BucketStore
from tessera.streaming.ingest import reduce_events
from tessera.streaming.stateful import PROVIDER, out_schema, reduce_stream

PHRASE = "the_of and_the theaea. the the"
r6 = lambda c: F.round(c, 6)


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def bench_queries(spark: SparkSession, d: str) -> DataFrame:
    """(query_id, query, q_vec)."""
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.coalesce("text", F.lit("")).alias("query"))
    return q.join(table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q_vec")), "query_id", "left")


def one_query(spark: SparkSession, text: str) -> DataFrame:
    return spark.range(1).select(F.lit(0).cast("long").alias("query_id"), F.lit(text).alias("query"))


def bm25_topk_on(corpus: DataFrame | KeywordIndex, spark: SparkSession, d: str) -> DataFrame:
    """Ten best English documents for one query, statistics over all languages."""
    found = kw.bm25_search(corpus, one_query(spark, "the annle thendor of worthless"), 10, product="en", key="doc_id", product_col="lang")
    return found.select("doc_id", r6("score").alias("score"), F.col("rank").cast("long").alias("rank"))


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return bm25_topk_on(corpus(spark, d), spark, d)


def bm25_scan(spark: SparkSession, d: str) -> DataFrame:
    """The same without an index: the texts are read and split for this one query."""
    return bm25_topk_on(docs(spark, d), spark, d)


def bm25_scoped(spark: SparkSession, d: str) -> DataFrame:
    found = kw.bm25_search(corpus(spark, d), one_query(spark, "the annle thendor of worthless"), 10, "en", ["src0", "src3"], "doc_id", "lang", "source")
    return found.select("doc_id", r6("score").alias("score"), F.col("rank").cast("long").alias("rank"))


def bm25_phrase(spark: SparkSession, d: str) -> DataFrame:
    found = kw.bm25_best(corpus(spark, d), one_query(spark, PHRASE), 20, "doc_id")
    return found.select("doc_id", r6("score").alias("score"), F.col("rank").cast("long").alias("rank"))


def bm25_multi_query_on(corpus: DataFrame | KeywordIndex, spark: SparkSession, d: str) -> DataFrame:
    found = kw.bm25_best(corpus, bench_queries(spark, d), 10, "doc_id")
    return found.select("query_id", "doc_id", r6("score").alias("score"), F.col("rank").cast("long").alias("rank"))


def bm25_multi_query(spark: SparkSession, d: str) -> DataFrame:
    return bm25_multi_query_on(corpus(spark, d), spark, d)


def keyword_index(spark: SparkSession, d: str) -> KeywordIndex:
    """A stored index of the documents in the shared folder."""
    return KeywordIndex.build(docs(spark, d), scratch_path(spark, "keyword-index"), "doc_id", ["lang", "source"])


_indexes: dict[tuple, KeywordIndex] = {}


def corpus(spark: SparkSession, d: str) -> KeywordIndex:
    """The documents' index, built once for each session and state of the table's files: what a service keeps ready."""
    jp = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/documents.parquet")
    fs = jp.getFileSystem(spark._jsc.hadoopConfiguration())
    state = tuple((s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(jp))
    at = (spark.sparkContext.applicationId, scratch_root(spark), d, state)
    if at not in _indexes or not _stands(spark, _indexes[at].path):
        _indexes[at] = keyword_index(spark, d)
    return _indexes[at]


def _stands(spark: SparkSession, path: str) -> bool:
    jp = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/totals")
    return jp.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jp)


def bm25_after_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The benchmark searched on a stored index after every third document got three more words and every tenth was removed."""
    index, rows = keyword_index(spark, d), docs(spark, d)
    index.upsert(rows.where("doc_id % 3 = 0").withColumn("text", F.concat("text", F.lit(" annle license café"))), rows.where("doc_id % 10 = 7 AND doc_id % 3 <> 0"))
    return bm25_multi_query_on(index, spark, d)


def token_doc_freq(spark: SparkSession, d: str) -> DataFrame:
    return kw.token_df(corpus(spark, d), bench_queries(spark, d), key="doc_id").select("query_id", "phrase", F.col("df").cast("long").alias("df"))


def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    return kw.corpus_stats(docs(spark, d)).select("n", r6("avgdl").alias("avgdl"))


def content_tokens(spark: SparkSession, d: str) -> DataFrame:
    return bench_queries(spark, d).select("query_id", F.array_join(tx.content_tokens(F.col("query")), " ").alias("tokens"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    return v.select(F.col("vec_id").alias("doc_id"), "embedding", F.col("label").cast("string").alias("product"))


def _vec_query(spark: SparkSession, d: str, which: str) -> DataFrame:
    return table(spark, d, "embeddings").where(which).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q_vec"))


def _hits(df: DataFrame) -> DataFrame:
    return df.select("query_id", "doc_id", r6("score").alias("score"), F.col("rank").cast("long").alias("rank"))


def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    return _hits(cosine_search(vectors(spark, d), _vec_query(spark, d, "vec_id = 0"), 10, "doc_id"))


def cosine_filtered(spark: SparkSession, d: str) -> DataFrame:
    return _hits(cosine_search(vectors(spark, d), _vec_query(spark, d, "vec_id = 0"), 10, "doc_id", product="3"))


def cosine_multi_query(spark: SparkSession, d: str) -> DataFrame:
    return _hits(cosine_search(vectors(spark, d), _vec_query(spark, d, "vec_id % 100 = 0"), 10, "doc_id"))


def vector_store(spark: SparkSession, d: str) -> VectorStore:
    """The vectors as stored collections in the shared folder, one a label."""
    v = vectors(spark, d)
    products = tuple(sorted(r[0] for r in v.select("product").distinct().collect()))  # a handful
    store = VectorStore.create(spark, scratch_path(spark, "vectors"), 64, v.select("doc_id").schema, "doc_id", products)
    store.upsert(v, v)
    return store


def cosine_after_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Searches in one collection after every third vector was turned around and moved to it, and every tenth was removed."""
    store, v = vector_store(spark, d), vectors(spark, d)
    moved = v.where("doc_id % 3 = 0").select("doc_id", F.reverse("embedding").alias("embedding"), F.lit("3").alias("product"))
    store.upsert(moved, moved)
    store.remove(v.where("doc_id % 10 = 7 AND doc_id % 3 <> 0"))
    return _hits(store.search(_vec_query(spark, d, "vec_id % 100 = 0"), 10, "3"))


def vector_lists(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of ids divisible by 100 searched among all by the lists of an inverted file, as trained; with the share of the exact hits that is found."""
    store = vector_store(spark, d).train(scratch_path(spark, "lists"))
    q = _vec_query(spark, d, "vec_id % 100 = 0")
    recall = store.recall(q).first().recall
    return _hits(store.search(q, 10, probes=None)).withColumn("recall", F.lit(recall))


def bucket_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as documents of a bucketed table: every third one is replaced by its first turn, new ones come, a replayed batch does nothing."""
    rows = table(spark, d, "conversations").select("conv_id", F.concat_ws(":", "conv_id", "turn").alias("id"), F.lit(0).alias("version"))
    store = BucketStore(spark, scratch_path(spark, "buckets"), rows.schema, group="conv_id", buckets=16)
    store.merge(rows, stream="s", batch=0)
    first = rows.where("conv_id % 3 = 0 AND id LIKE '%:0'").withColumn("version", F.lit(1))
    store.merge(first, replace=True, stream="s", batch=1)
    new = rows.where("conv_id % 5 = 0").select((F.col("conv_id") + 1_000_000).alias("conv_id"), F.concat(F.lit("n"), "id").alias("id"), F.lit(2).alias("version"))
    for batch in (2, 2, 1):
        store.merge(new, stream="s", batch=batch)
    return store.read().groupBy("conv_id", "version").agg(F.countDistinct("id").alias("n"))


def markdown_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Turns as Markdown: an indented heading, a mark without a title, which is text, and the turn's first line."""
    line = F.trim(F.regexp_extract("text", r"^[^\r\n]*", 0))
    made = table(spark, d, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("doc_id"), F.concat(F.lit("# Turn "), "turn", F.lit("\n\n   ## "), "role", F.lit("  \n# \n"), line, F.lit("\n\n#### end")).alias("text"))
    return text_blocks(made).select("doc_id", F.col("block_no").cast("long").alias("block_no"), F.array_join("section_path", " > ").alias("path"), F.sha2("text", 256).alias("sha"))


def judge_prompts(spark: SparkSession, d: str) -> DataFrame:
    """The prompt that a judge would get for each benchmark query and its keyword hits."""
    hits = F.broadcast(kw.bm25_best(corpus(spark, d), bench_queries(spark, d), 3, "doc_id")).join(docs(spark, d).select("doc_id", "text", "lang", "source"), "doc_id")
    chunks = hits.select("query_id", "rank", F.round("score", 3).alias("score"), F.array("lang", "source").alias("section_path"), "text")
    rows = bench_queries(spark, d).select("query_id", F.col("query").alias("question"), F.lit("an answer").alias("answer"))
    return evals.judge_prompts(rows, chunks).select("query_id", F.sha2("prompt", 256).alias("sha"))


def first_per_product(spark: SparkSession, d: str) -> DataFrame:
    return catalog.first_per_group(docs(spark, d).select("lang", "doc_id"), "lang", "doc_id", 3)


def semantic_units(spark: SparkSession, d: str) -> DataFrame:
    """Questions (from the documents' heads) by expected product and mode, without exact terms and adversarial ones, and their categories."""
    q = docs(spark, d).where("doc_id % 4 = 0").select(
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("adv-"), "doc_id")).otherwise(F.col("doc_id").cast("string")).alias("id"), F.substring("text", 1, 40).alias("question"),
        F.when(F.col("doc_id") % 8 == 0, F.array("lang", F.lit("all"))).otherwise(F.array("lang")).alias("expected_products"), F.array().cast("array<string>").alias("expected_section_keywords"), F.lit("").alias("notes"), F.when(F.col("doc_id") % 5 == 0, "exact_term").alias("tag"),
    )
    units = expand_modes(fetch_units(q), ["keyword_only", "hybrid"])
    return units.select("id", "product", "mode", tx.category(F.col("id"), F.col("tag"), F.col("expected_products")).alias("category"))


def align_judgments(spark: SparkSession, d: str) -> DataFrame:
    """Documents with their judgments, zero where there are none."""
    judged = table(spark, d, "labels").select(F.col("doc_id").alias("custom_id"), F.col("quality").alias("correctness"), F.col("toxic").alias("groundedness"), (F.col("quality") + F.col("toxic")).alias("citation_quality"))
    return evals.align_judgments(docs(spark, d).select(F.col("doc_id").alias("custom_id")), judged).select("custom_id", *(F.col(a).cast("long").alias(a) for a in evals.AXES))


def oov_summary(spark: SparkSession, d: str) -> DataFrame:
    """Misses of the vector leg and rescues over the benchmark: a hit holds `license` in the pool's first ten."""
    hits = F.broadcast(retrieve_modes(docs(spark, d), vectors(spark, d), bench_queries(spark, d), 10, key="doc_id", index=corpus(spark, d))).join(docs(spark, d).select("doc_id", "text"), "doc_id")
    ranks = hits.groupBy("query_id", "mode").agg(F.min(F.when(F.contains(F.lower("text"), F.lit("license")), F.col("rank"))).alias("rank"))
    every = bench_queries(spark, d).select("query_id", F.explode(F.array(*map(F.lit, MODES))).alias("mode"))
    return evals.oov_summary(every.join(ranks, ["query_id", "mode"], "left"), "query_id")


def stream_reduce(spark: SparkSession, d: str) -> DataFrame:
    """Turns as events of a stream, in batches out of order, reduced by the stateful operator; each conversation ends with a done event."""
    turns = table(spark, d, "conversations").withColumn("seq", F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "text")) - 1)
    made = turns.select("conv_id", "seq", F.when(F.col("role") == "assistant", "answer_delta").otherwise("tool_call").alias("type"), F.col("text").alias("payload"))
    done = turns.groupBy("conv_id").agg(F.count("*").cast("int").alias("seq")).select("conv_id", "seq", F.lit("done").alias("type"), F.lit(None).cast("string").alias("payload"))
    events = made.unionByName(done).select(F.col("conv_id").alias("request_id"), F.col("seq").cast("long").alias("seq"), "type", "payload", F.timestamp_seconds(F.col("seq") + 1_700_000_000).alias("ts"))
    path = scratch_path(spark, "events")
    events.repartition(4, F.xxhash64("request_id", "seq")).write.parquet(f"{path}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(f"{path}/in")
    held = {k: spark.conf.get(k, None) for k in ("spark.sql.streaming.stateStore.providerClass", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        out = reduce_stream(stream, "1 day", 600_000).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    finally:
        for k, v in held.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out.awaitTermination()
    rows = spark.read.schema(out_schema("long")).parquet(f"{path}/out")
    return rows.select(F.col("request_id").alias("conv_id"), F.sha2("answer", 256).alias("answer_sha"), F.size("steps").cast("long").alias("steps"), "done")


def tool_trace(spark: SparkSession, d: str) -> DataFrame:
    """The benchmark through the tool loop over two languages as products: number of results of every call."""
    chunks = docs(spark, d).where("lang IN ('en', 'fr')").select(F.col("doc_id").alias("chunk_id"), F.col("lang").alias("product"), F.col("source").alias("doc_id"), F.col("doc_id").alias("chunk_index"), "text", F.array("lang").alias("section_path"), F.lit("u").alias("source_url"))
    none = chunks.select("chunk_id", "product", "doc_id", F.array().cast("array<float>").alias("embedding")).limit(0)
    index = KeywordIndex.build(chunks, scratch_path(spark, "loop-index"), "chunk_id", ["product", "doc_id"])
    bases = [KnowledgeBase(chunks, none, p, index=index) for p in ("en", "fr")]
    requests = bench_queries(spark, d).select(F.col("query_id").alias("request_id"), "query", F.col("q_vec"))
    trace, _ = tool_loop(requests, bases, widening_router({"en": [" the "], "fr": [" le ", " la "]}), "keyword_only")
    return trace.select("request_id", F.col("step").cast("long").alias("step"), F.col("call_no").cast("long").alias("call_no"), "tool", "num_results")


def _legs(spark: SparkSession, d: str, depth: int = 30) -> tuple[DataFrame, DataFrame]:
    q = bench_queries(spark, d)
    return kw.bm25_best(corpus(spark, d), q, depth, "doc_id"), cosine_search(vectors(spark, d), q, depth, "doc_id")


def rrf_fuse(spark: SparkSession, d: str) -> DataFrame:
    b, v = _legs(spark, d)
    return _hits(fusion.rrf(b, v, 10, "doc_id"))


def weighted_fuse(spark: SparkSession, d: str) -> DataFrame:
    b, v = _legs(spark, d)
    return _hits(fusion.weighted(b, v, 10, 0.5, "doc_id"))


def adaptive_fuse(spark: SparkSession, d: str) -> DataFrame:
    b, v = _legs(spark, d)
    routed = fusion.route(bench_queries(spark, d), RetrievalConfig(hybrid_adaptive_signal="idf"), corpus(spark, d), "doc_id")
    return _hits(fusion.weighted(b, v, 10, routed.select("query_id", "alpha"), "doc_id"))


def pool_tail(spark: SparkSession, d: str) -> DataFrame:
    """Per query, how many of a 30-deep pool at alpha 1 came from the keyword leg alone."""
    b, v = _legs(spark, d)
    pool = fusion.weighted(b, v, 30, 1.0, "doc_id").join(v.select("query_id", "doc_id", F.lit(1).alias("in_v")), ["query_id", "doc_id"], "left")
    return pool.groupBy("query_id").agg(F.count("*").alias("pool"), F.count_if(F.col("in_v").isNull()).alias("keyword_only"))


def hybrid_modes(spark: SparkSession, d: str) -> DataFrame:
    """All four modes in one table."""
    q, out = bench_queries(spark, d), None
    for mode in ("keyword_only", "vector_only", "hybrid", "hybrid_rerank"):
        got = retrieve(docs(spark, d), vectors(spark, d), q, mode, 10, key="doc_id", product_col="lang", doc_col="source", index=corpus(spark, d)).select("query_id", "doc_id", r6("score").alias("score"), F.col("rank").cast("long").alias("rank"), "mode")
        out = got if out is None else out.unionByName(got)
    return out


def rerank_floor(spark: SparkSession, d: str) -> DataFrame:
    b, _ = _legs(spark, d)
    pairs = F.broadcast(b.select("query_id", "doc_id", "rank")).join(docs(spark, d).select("doc_id", "text"), "doc_id").join(bench_queries(spark, d).select("query_id", "query"), "query_id")
    return _hits(fusion.rerank(pairs, 5, 0.5, fusion.lexical_rerank(F.col("query"), F.col("text")), "doc_id"))


def lexical_router(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", F.coalesce(tx.is_lexical(F.col("text")), F.lit(False)).alias("lexical"))


def count_by_product(spark: SparkSession, d: str) -> DataFrame:
    return catalog.count_by_product(docs(spark, d), "lang")


def distinct_topics(spark: SparkSession, d: str) -> DataFrame:
    """First word of each page's URL path, cleaned of leading numbers."""
    paths = table(spark, d, "pages").select(F.array(F.concat(F.lit("1.2 "), F.regexp_extract("url", "^[a-z]+://[^/]+/([^/?#]*)", 1))).alias("section_path"))
    return catalog.list_topics(paths)


def document_rebuild(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").withColumnsRenamed({"conv_id": "doc_id", "turn": "chunk_index"})
    return catalog.rebuild_documents(c).select("doc_id", F.sha2("full_text", 256).alias("sha"), "n_chunks")


def reconcile(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").join(docs(spark, d).select("doc_id", "lang"), F.col("vec_id") == F.col("doc_id"))
    return catalog.reconcile(docs(spark, d), v, "lang")


def clean_heading(spark: SparkSession, d: str) -> DataFrame:
    head = F.concat_ws(" ", F.concat(F.col("doc_id") % 7, F.lit("."), F.col("doc_id") % 5), F.substring_index("text", " ", 3))
    return docs(spark, d).select("doc_id", tx.clean_heading(head).alias("heading"))


def slug_for_url(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", tx.slug_for_url(F.col("url"), "/a/").alias("slug"))


def crawl_scope(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", tx.in_scope(F.col("url"), "https://", "https://").alias("ok"), tx.urldefrag(F.col("url")).alias("bare"))


def upsert_merge(spark: SparkSession, d: str) -> DataFrame:
    """Every third document rewritten, and one tenth as many new ones."""
    old = docs(spark, d).select("doc_id", "lang", F.lit(0).cast("long").alias("version"))
    new = old.where("doc_id % 3 = 0").withColumn("version", F.lit(1).cast("long"))
    more = old.where("doc_id % 10 = 0").select((F.col("doc_id") + 1_000_000_000).alias("doc_id"), "lang", F.lit(2).cast("long").alias("version"))
    return catalog.upsert(old, new.unionByName(more), "doc_id")


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    """Keyword hits of the benchmark with their grades."""
    hits = kw.bm25_best(corpus(spark, d), bench_queries(spark, d), 10, "doc_id")
    grades = table(spark, d, "labels").select("doc_id", (2 * F.col("quality") + 1 - F.col("toxic")).alias("grade"))
    return hits.join(grades, "doc_id", "left")


def first_match_rank(spark: SparkSession, d: str) -> DataFrame:
    hits = F.broadcast(kw.bm25_best(corpus(spark, d), bench_queries(spark, d), 10, "doc_id")).join(docs(spark, d).select("doc_id", "text"), "doc_id")
    found = evals.first_match(hits, F.col("text"), F.array(F.lit("Idiot"), F.lit("license")), ["query_id"])
    return found.select("query_id", F.col("rank").cast("long").alias("rank"))


def recall_mrr(spark: SparkSession, d: str) -> DataFrame:
    best = _ranked(spark, d).groupBy("query_id").agg(F.min(F.when(F.col("grade") >= 3, F.col("rank"))).alias("rank")).withColumn("mode", F.lit("keyword_only"))
    out = evals.hit_rates(best, ["mode"])
    return out.select("mode", "n", *(r6(c).alias(c) for c in out.columns[2:]))


def recall_by_category(spark: SparkSession, d: str) -> DataFrame:
    best = _ranked(spark, d).groupBy("query_id").agg(F.min(F.when(F.col("grade") >= 3, F.col("rank"))).alias("rank"))
    rows = best.withColumn("mode", F.lit("keyword_only")).withColumn("category", F.when(F.col("query_id") % 2 == 0, "single").otherwise("cross"))
    aggs = [F.count("*").alias("n"), r6(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0)))).alias("mrr")]
    return evals.overall_and_by(rows, "mode", "category", aggs).select(F.coalesce("category", F.lit("overall")).alias("category"), "n", "mrr")


def _pooled(spark: SparkSession, d: str, without: Column | None = None) -> DataFrame:
    """The ten best of each mode, but for the hits of `without`, judged by the labels over the pool of all modes."""
    hits = retrieve_modes(docs(spark, d), vectors(spark, d), bench_queries(spark, d), 10, key="doc_id", index=corpus(spark, d))
    hits = materialize(hits if without is None else hits.where(~without), "pool")
    grades = table(spark, d, "labels").select("doc_id", (2 * F.col("quality") + 1 - F.col("toxic")).alias("grade"))
    qrels = evals.pool(hits, "doc_id").join(grades, "doc_id", "left").withColumn("grade", F.coalesce("grade", F.lit(0)))
    return evals.pooled_eval(hits, qrels, 10, key="doc_id", modes=MODES)


def ndcg(spark: SparkSession, d: str) -> DataFrame:
    return _pooled(spark, d).select("query_id", "mode", r6("set_recall").alias("set_recall"), r6("ndcg").alias("ndcg"), "gold_n", "pool_n")


def pool_stats(spark: SparkSession, d: str) -> DataFrame:
    out = evals.pooled_summary(_pooled(spark, d))
    return out.select("mode", "n", *(r6(c).alias(c) for c in ("set_recall", "ndcg", "pool", "gold")))


def pool_empty_modes(spark: SparkSession, d: str) -> DataFrame:
    """The pooled means where the keyword leg finds nothing for every fifth query: it counts 0 there."""
    out = evals.pooled_summary(_pooled(spark, d, (F.col("mode") == "keyword_only") & (F.col("query_id") % 5 == 0)))
    return out.select("mode", "n", *(r6(c).alias(c) for c in ("set_recall", "ndcg", "pool", "gold")))


def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return evals.percentiles(table(spark, d, "events"), "event_type", "value").select("event_type", F.col("n").cast("long").alias("n"), "p50", "p95")


def routing_accuracy(spark: SparkSession, d: str) -> DataFrame:
    sets = table(spark, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("called"), F.collect_set(F.when(F.col("event_id") % 3 != 0, F.col("event_type"))).alias("expected"))
    ok = evals.routing_correct(F.col("expected"), F.col("called"))
    return sets.agg(F.count("*").alias("n"), r6(F.avg(ok.cast("double"))).alias("accuracy"))


def judge_means(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_type", (F.col("event_id") % 6).alias("correctness"), (F.col("user_id") % 6).alias("groundedness"), ((F.col("event_id") + F.col("user_id")) % 6).alias("citation_quality"))
    out = evals.judge_means(rows, "event_type")
    return out.select("event_type", "n", *(r6(c).alias(c) for c in (*evals.AXES, "quality")))


def _usage(spark: SparkSession, d: str) -> DataFrame:
    c, size = table(spark, d, "conversations"), F.length("text")
    part = lambda cond: F.coalesce(F.sum(F.when(cond, size)), F.lit(0))
    return c.groupBy("conv_id").agg(part((F.col("role") == "user") & (F.col("turn") == 0)).alias("cw"), part((F.col("role") == "user") & (F.col("turn") > 0)).alias("ti"), part(F.col("role") == "assistant").alias("out"), part(F.col("turn") >= 2).alias("cr"))


def cost_usd(spark: SparkSession, d: str) -> DataFrame:
    u = _usage(spark, d)
    return u.select("conv_id", evals.cost_usd(F.col("ti"), F.col("out"), F.col("cw"), F.col("cr")).alias("usd"))


def cache_hit_ratio(spark: SparkSession, d: str) -> DataFrame:
    return _usage(spark, d).select("conv_id", r6(evals.cache_hit_ratio(F.col("cr"), F.col("ti"), F.col("cw"))).alias("ratio"))


def event_reduce(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("role") == "assistant", "answer_delta").otherwise("tool_call").alias("type"), F.col("text").alias("payload"))
    out = reduce_events(c, "conv_id", "turn")
    return out.select("conv_id", F.sha2("answer", 256).alias("answer_sha"), F.size("steps").cast("long").alias("steps"), "done")


def json_judge_parse(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit('Sure: {"correctness": "'), F.col("event_id") % 8, F.lit('", "groundedness": '), F.col("user_id") % 6, F.lit(', "citation_quality": "n/a"} Done.'))
    j = evals.parse_judgment(F.when(F.col("event_id") % 5 == 0, "no json").otherwise(text))
    return table(spark, d, "events").select("event_id", *(j[a].cast("long").alias(a) for a in evals.AXES))


def chunk_id_uuid5(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", tx.chunk_id(F.col("doc_id").cast("string"), F.lit(0)).alias("id"))


def html_blocks_q(spark: SparkSession, d: str) -> DataFrame:
    return html_blocks(table(spark, d, "pages"), "page_id")


def html_chunks(spark: SparkSession, d: str) -> DataFrame:
    return pack_chunks(html_blocks(table(spark, d, "pages"), "page_id"), "page_id", 40, 80)


def page_facts_q(spark: SparkSession, d: str) -> DataFrame:
    return page_facts(table(spark, d, "pages"), "page_id")


def crawl_bfs(spark: SparkSession, d: str) -> DataFrame:
    """A crawl of at most 60 pages over a tree made of the table's ids: page i links to pages 2 i + 1 and 2 i + 2."""
    link = lambda i: F.concat(F.lit('<a href="p'), (F.col("page_id") * 2 + i).cast("string"), F.lit('.html#x">n</a>'))
    made = table(spark, d, "pages").select(F.concat(F.lit("https://h/s/p"), "page_id", F.lit(".html")).alias("url"), F.concat(F.lit("<p>x</p>"), link(1), link(2)).alias("html"))
    return crawl(made, "https://h/s/p0.html", "https://h/", "https://h/s/", 60, "/s/").select("url", "doc_id", F.col("place").cast("long").alias("place"))


def windowed_events(spark: SparkSession, d: str) -> DataFrame:
    ts = table(spark, d, "events").groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour"), "event_type").agg(F.count("*").alias("n"))
    return ts.select(F.unix_seconds(F.col("window.start")).alias("start_s"), "event_type", "n")


# ---------------------------------------------------------------------------------------------------------------
STOP = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"
TERMS = "regexp_extract_all(lower(strip_accents({})), '[\\p{{L}}\\p{{N}}\\p{{Co}}]+')"
CORPUS = f"""
tok AS (SELECT doc_id, lang, source, {TERMS.format("text")} t FROM documents),
stats AS (SELECT count(*) n, avg(len(t)) avgdl FROM tok),
pos AS (SELECT doc_id, lang, source, len(t) dl, unnest(t) term, generate_subscripts(t, 1) pos FROM tok)"""


def _phrases(queries: str) -> str:
    return f"""
qs AS ({queries}),
qt AS (SELECT query_id, regexp_extract_all(lower(query), '[\\p{{L}}\\p{{N}}\\p{{M}}_]+') toks FROM qs),
cf AS (SELECT query_id, toks, list_filter(toks, lambda x: length(x) > 1 AND NOT list_contains({STOP}, x)) c FROM qt),
ct AS (SELECT query_id, CASE WHEN len(c) > 0 THEN c ELSE toks END c FROM cf),
ph AS (SELECT query_id, p, count(*) mult FROM (SELECT query_id, unnest(c) p FROM ct) GROUP BY ALL),
pt AS (SELECT p, {TERMS.format("p")} terms FROM (SELECT DISTINCT p FROM ph)),
pterm AS (SELECT p, len(terms) nt, unnest(terms) term, generate_subscripts(terms, 1) i FROM pt),
occ AS (SELECT p, nt, doc_id, lang, source, dl, pos - i AS start, count(*) m FROM pos JOIN pterm USING (term) GROUP BY ALL),
f AS (SELECT p, doc_id, lang, source, dl, count(*) f FROM occ WHERE m = nt GROUP BY ALL),
dfs AS (SELECT p, count(*) df FROM f GROUP BY p),
w AS (SELECT p, avgdl, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END idf FROM dfs, stats),
sc AS (SELECT query_id, doc_id, lang, source, round(sum(mult * idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) score FROM f JOIN w USING (p) JOIN ph USING (p) GROUP BY ALL)"""


BENCH = "SELECT item_id query_id, coalesce(text, '') query FROM benchmark"
ONE = "SELECT 0 query_id, '{}' query"


def _bm25(queries: str, k: int, where: str = "true", cols: str = "doc_id, round(score, 6) score, rank", corpus: str = CORPUS) -> str:
    return f"WITH {corpus}, {_phrases(queries)}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) rank FROM sc WHERE {where}) SELECT {cols} FROM r WHERE rank <= {k}"


UPSERTED = "FROM (SELECT doc_id, lang, source, CASE WHEN doc_id % 3 = 0 THEN text || ' annle license café' ELSE text END text FROM documents WHERE doc_id % 10 <> 7 OR doc_id % 3 = 0)"
LEXICAL_SQL = "[\\p{L}\\p{N}\\p{M}_]+_[\\p{L}\\p{N}\\p{M}_]+|[\\p{L}\\p{N}\\p{M}_]+(?:\\.[\\p{L}\\p{N}\\p{M}_]+){2,}"
KLEG = "bl AS (SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) rank FROM sc) WHERE rank <= 30)"
VLEG = """vl AS (SELECT * FROM (SELECT b.item_id query_id, e.vec_id doc_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) score,
 row_number() OVER (PARTITION BY b.item_id ORDER BY round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) DESC, e.vec_id) rank
 FROM benchmark b JOIN embeddings q ON q.vec_id = b.item_id CROSS JOIN embeddings e) WHERE rank <= 30)"""
LEGS = f"WITH {CORPUS}, {_phrases(BENCH)}, {KLEG}, {VLEG}"
NORM = """,
bn AS (SELECT query_id, doc_id, rank, CASE WHEN max(score) OVER q > min(score) OVER q THEN (score - min(score) OVER q) / (max(score) OVER q - min(score) OVER q) ELSE 1.0 END s FROM bl WINDOW q AS (PARTITION BY query_id)),
vn AS (SELECT query_id, doc_id, rank, CASE WHEN max(score) OVER q > min(score) OVER q THEN (score - min(score) OVER q) / (max(score) OVER q - min(score) OVER q) ELSE 1.0 END s FROM vl WINDOW q AS (PARTITION BY query_id)),
lg AS (SELECT query_id, doc_id, coalesce(vn.s, 0) vs, coalesce(bn.s, 0) bs, coalesce(bn.rank, vn.rank + 1000000) tie, vn.rank IS NULL only_b FROM bn FULL OUTER JOIN vn USING (query_id, doc_id))"""


def _weighted(alpha: str, k: int, extra: str = "", join: str = "") -> str:
    return f"{LEGS}{NORM}{extra}, s AS (SELECT lg.*, {alpha} * vs + (1 - {alpha}) * bs score FROM lg {join}), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, tie) rank FROM s)"


def _cosine(which: str, k: int, where: str = "true") -> str:
    return f"""WITH s AS (SELECT q.vec_id query_id, e.vec_id doc_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) score FROM embeddings e, embeddings q WHERE {which} AND {where}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) rank FROM s) SELECT query_id, doc_id, round(score, 6) score, rank FROM r WHERE rank <= {k}"""


RANKED = f"WITH {CORPUS}, {_phrases(BENCH)}, {KLEG}, rk AS (SELECT bl.*, 2 * quality + 1 - toxic grade FROM bl LEFT JOIN labels USING (doc_id) WHERE rank <= 10)"
BEST = RANKED + ", best AS (SELECT query_id, min(rank) FILTER (WHERE grade >= 3) rank FROM rk GROUP BY query_id)"
MODES_SQL = (
    LEGS
    + NORM
    + f""", al AS (SELECT query_id, CASE WHEN coalesce(regexp_matches(query, '{LEXICAL_SQL}'), false) THEN 0.3 ELSE 1.0 END alpha FROM qs),
hs AS (SELECT lg.*, alpha * vs + (1 - alpha) * bs score FROM lg JOIN al USING (query_id)),
hr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, tie) rank FROM hs),
qq AS (SELECT query_id, list_distinct(flatten(list_transform(c, lambda x: {TERMS.format("x")}))) terms FROM ct),
cand AS (SELECT query_id, doc_id, rank first_rank, CASE WHEN len(terms) > 0 THEN len(list_intersect(terms, t)) / len(terms) ELSE 0.0 END score FROM hr JOIN qq USING (query_id) JOIN tok USING (doc_id) WHERE rank <= 30),
rr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first_rank) rank FROM cand),
modes AS (SELECT 'keyword_only' AS mode, query_id, doc_id, score, rank FROM bl WHERE rank <= 10 UNION ALL SELECT 'vector_only', query_id, doc_id, score, rank FROM vl WHERE rank <= 10
UNION ALL SELECT 'hybrid', query_id, doc_id, score, rank FROM hr WHERE rank <= 10 UNION ALL SELECT 'hybrid_rerank', query_id, doc_id, score, rank FROM rr WHERE rank <= 10 AND score >= 0.1)"""
)
POOLED = (
    MODES_SQL
    + """, qr AS (SELECT query_id, doc_id, coalesce(2 * quality + 1 - toxic, 0) grade FROM (SELECT DISTINCT query_id, doc_id FROM modes) LEFT JOIN labels USING (doc_id)),
qi AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, doc_id) r FROM qr),
ideal AS (SELECT query_id, sum(CASE WHEN r <= 10 THEN grade / log2(r + 1.0) END) idcg, count(*) FILTER (WHERE grade >= 2) gold_n, count(*) pool_n FROM qi GROUP BY 1),
got AS (SELECT query_id, mode, sum(grade / log2(rank + 1.0)) dcg, count(*) FILTER (WHERE grade >= 2) found FROM modes JOIN qr USING (query_id, doc_id) GROUP BY ALL),
u AS (SELECT query_id, mode, CASE WHEN gold_n > 0 THEN coalesce(found, 0) / gold_n END set_recall, CASE WHEN idcg > 0 THEN coalesce(dcg, 0) / idcg ELSE 0.0 END ndcg, gold_n, pool_n
FROM ideal CROSS JOIN (VALUES ('keyword_only'), ('vector_only'), ('hybrid'), ('hybrid_rerank')) v(mode) LEFT JOIN got USING (query_id, mode))"""
)
USAGE = """WITH u AS (SELECT conv_id, coalesce(sum(length(text)) FILTER (WHERE role = 'user' AND turn = 0), 0)::BIGINT cw, coalesce(sum(length(text)) FILTER (WHERE role = 'user' AND turn > 0), 0)::BIGINT ti,
coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT o, coalesce(sum(length(text)) FILTER (WHERE turn >= 2), 0)::BIGINT cr FROM conversations GROUP BY conv_id)"""
_T = "the annle thendor of worthless"
_PATH = "regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '^[a-zA-Z]+://[^/]*', ''), '\\?.*$', '')"

SQL: dict[str, str] = {
    "bm25_topk": _bm25(ONE.format(_T), 10, "lang = 'en'"),
    "bm25_scan": _bm25(ONE.format(_T), 10, "lang = 'en'"),
    "bm25_scoped": _bm25(ONE.format(_T), 10, "lang = 'en' AND source IN ('src0', 'src3')"),
    "bm25_phrase": _bm25(ONE.format(PHRASE), 20),
    "bm25_multi_query": _bm25(BENCH, 10, cols="query_id, doc_id, round(score, 6) score, rank"),
    "bm25_after_upsert": _bm25(BENCH, 10, cols="query_id, doc_id, round(score, 6) score, rank", corpus=CORPUS.replace("FROM documents", UPSERTED)),
    "token_doc_freq": f"WITH {CORPUS}, {_phrases(BENCH)} SELECT query_id, p phrase, coalesce(df, 0) df FROM ph LEFT JOIN dfs USING (p)",
    "corpus_stats": f"WITH {CORPUS} SELECT n, round(avgdl, 6) avgdl FROM stats",
    "content_tokens": f"WITH {CORPUS}, {_phrases(BENCH)} SELECT query_id, array_to_string(c, ' ') tokens FROM ct",
    "cosine_topk": _cosine("q.vec_id = 0", 10),
    "cosine_filtered": _cosine("q.vec_id = 0", 10, "e.label = 3"),
    "cosine_multi_query": _cosine("q.vec_id % 100 = 0", 10),
    "cosine_after_upsert": """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN list_reverse(embedding) ELSE embedding END e, CASE WHEN vec_id % 3 = 0 THEN 3 ELSE label END p FROM embeddings WHERE vec_id % 10 <> 7 OR vec_id % 3 = 0),
s AS (SELECT q.vec_id query_id, v.vec_id doc_id, round(list_cosine_similarity(v.e::DOUBLE[], q.embedding::DOUBLE[]), 9) score FROM v, embeddings q WHERE q.vec_id % 100 = 0 AND p = 3),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) rank FROM s) SELECT query_id, doc_id, round(score, 6) score, rank FROM r WHERE rank <= 10""",
    "bucket_upsert": "WITH r AS (SELECT conv_id, turn, 0 AS version FROM conversations WHERE NOT (conv_id % 3 = 0 AND conv_id IN (SELECT conv_id FROM conversations WHERE turn = 0)) UNION ALL SELECT conv_id, turn, 1 FROM conversations WHERE conv_id % 3 = 0 AND turn = 0 UNION ALL SELECT conv_id + 1000000, turn, 2 FROM conversations WHERE conv_id % 5 = 0) SELECT conv_id, version, count(DISTINCT turn) n FROM r GROUP BY ALL",
    "markdown_blocks": r"SELECT conv_id || ':' || turn doc_id, 0::BIGINT block_no, 'Turn ' || turn || ' > ' || role AS path, sha256(trim('# ' || trim(regexp_extract(text, '^[^\r\n]*', 0)))) sha FROM conversations UNION ALL SELECT conv_id || ':' || turn, 1, 'Turn ' || turn || ' > ' || role, sha256('#### end') FROM conversations",
    "judge_prompts": f"WITH {CORPUS}, {_phrases(BENCH)}, {KLEG}, h AS (SELECT query_id, string_agg('- [' || round(score, 3)::VARCHAR || '] ' || lang || ' > ' || source || ': ' || text, chr(10) ORDER BY rank) c FROM bl JOIN documents USING (doc_id) WHERE rank <= 3 GROUP BY 1) SELECT query_id, sha256('QUESTION:' || chr(10) || query || chr(10) || chr(10) || 'ANSWER TO EVALUATE:' || chr(10) || 'an answer' || chr(10) || chr(10) || 'RETRIEVED CHUNKS (the answer should be grounded in these):' || chr(10) || coalesce(c, '(no chunks retrieved)')) sha FROM qs LEFT JOIN h USING (query_id)",
    "first_per_product": "SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) i FROM documents) WHERE i <= 3",
    "semantic_units": "WITH q AS (SELECT doc_id::VARCHAR AS id, doc_id, CASE WHEN doc_id % 8 = 0 THEN [lang, 'all'] ELSE [lang] END e FROM documents WHERE doc_id % 4 = 0 AND doc_id % 3 <> 0 AND doc_id % 5 <> 0) SELECT id, p product, mode, CASE WHEN len(e) > 1 THEN 'cross' ELSE 'single' END category FROM (SELECT id, e, unnest(e) p FROM q), (VALUES ('keyword_only'), ('hybrid')) v(mode)",
    "align_judgments": "SELECT doc_id custom_id, coalesce(quality, 0)::BIGINT correctness, coalesce(toxic, 0)::BIGINT groundedness, coalesce(quality + toxic, 0)::BIGINT citation_quality FROM documents LEFT JOIN labels USING (doc_id)",
    "oov_summary": MODES_SQL + ", rk AS (SELECT query_id, mode, min(rank) FILTER (WHERE contains(lower(text), 'license')) rank FROM modes JOIN documents USING (doc_id) GROUP BY ALL), ow AS (SELECT query_id, min(rank) FILTER (WHERE mode = 'keyword_only') k, min(rank) FILTER (WHERE mode = 'vector_only') v, min(rank) FILTER (WHERE mode = 'hybrid_rerank') r FROM qs LEFT JOIN rk USING (query_id) GROUP BY 1) SELECT count(*) FILTER (WHERE v IS NULL) vector_misses, count(*) FILTER (WHERE v IS NULL AND k IS NOT NULL) keyword_rescues, count(*) FILTER (WHERE v IS NULL AND r IS NOT NULL) rerank_rescues FROM ow",
    "stream_reduce": "SELECT conv_id, sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, text), '')) answer_sha, count(*) FILTER (WHERE role <> 'assistant') steps, true AS done FROM conversations GROUP BY conv_id",
    "rrf_fuse": f"{LEGS}, lg AS (SELECT query_id, doc_id, coalesce(1.0 / (60 + vl.rank), 0) + coalesce(1.0 / (60 + bl.rank), 0) score, coalesce(vl.rank, bl.rank + 1000000) tie FROM bl FULL OUTER JOIN vl USING (query_id, doc_id)), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, tie) rank FROM lg) SELECT query_id, doc_id, round(score, 6) score, rank FROM r WHERE rank <= 10",
    "weighted_fuse": _weighted("0.5", 10) + " SELECT query_id, doc_id, round(score, 6) score, rank FROM r WHERE rank <= 10",
    "adaptive_fuse": _weighted("alpha", 10, ", al AS (SELECT query_id, CASE WHEN min(coalesce(df, 0)) <= 5 THEN 0.3 ELSE 1.0 END alpha FROM ph LEFT JOIN dfs USING (p) GROUP BY query_id)", "JOIN al USING (query_id)") + " SELECT query_id, doc_id, round(score, 6) score, rank FROM r WHERE rank <= 10",
    "pool_tail": _weighted("1.0", 30) + " SELECT query_id, count(*) pool, count(*) FILTER (WHERE only_b) keyword_only FROM r WHERE rank <= 30 GROUP BY query_id",
    "rerank_floor": f"{LEGS}, qq AS (SELECT query_id, list_distinct(flatten(list_transform(c, lambda x: {TERMS.format('x')}))) terms FROM ct), p AS (SELECT query_id, doc_id, rank first_rank, CASE WHEN len(terms) > 0 THEN len(list_intersect(terms, t)) / len(terms) ELSE 0.0 END score FROM bl JOIN qq USING (query_id) JOIN tok USING (doc_id)), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first_rank) rank FROM p) SELECT query_id, doc_id, round(score, 6) score, rank FROM r WHERE rank <= 5 AND score >= 0.5",
    "hybrid_modes": MODES_SQL + " SELECT query_id, doc_id, round(score, 6) score, rank, mode FROM modes",
    "lexical_router": f"SELECT doc_id, coalesce(regexp_matches(text, '{LEXICAL_SQL}'), false) lexical FROM documents",
    "count_by_product": "SELECT lang, count(*) n FROM documents GROUP BY lang",
    "distinct_topics": "SELECT DISTINCT topic FROM (SELECT CASE WHEN trim(regexp_replace('1.2 ' || p, '^\\d+(\\.\\d+)*\\s+', '')) <> '' THEN trim(regexp_replace('1.2 ' || p, '^\\d+(\\.\\d+)*\\s+', '')) ELSE '1.2 ' || p END topic FROM (SELECT regexp_extract(url, '^[a-z]+://[^/]+/([^/?#]*)', 1) p FROM pages))",
    "document_rebuild": "SELECT conv_id doc_id, sha256(string_agg(text, chr(10) || chr(10) ORDER BY turn, text)) sha, count(*) n_chunks FROM conversations GROUP BY conv_id",
    "reconcile": "WITH a AS (SELECT lang, count(*) n_chunks FROM documents GROUP BY 1), b AS (SELECT lang, count(*) n_vectors FROM embeddings JOIN documents ON vec_id = doc_id GROUP BY 1) SELECT lang, coalesce(n_chunks, 0) n_chunks, coalesce(n_vectors, 0) n_vectors, CASE WHEN coalesce(n_chunks, 0) = coalesce(n_vectors, 0) THEN 'OK' ELSE 'MISMATCH' END status FROM a FULL OUTER JOIN b USING (lang)",
    "clean_heading": "WITH h AS (SELECT doc_id, (doc_id % 7) || '.' || (doc_id % 5) || ' ' || array_to_string(list_slice(string_split(text, ' '), 1, 3), ' ') h FROM documents) SELECT doc_id, CASE WHEN length(trim(regexp_replace(h, '^\\d+(\\.\\d+)*\\s+', ''))) > 0 THEN trim(regexp_replace(h, '^\\d+(\\.\\d+)*\\s+', '')) ELSE h END heading FROM h",
    "slug_for_url": f"WITH p AS (SELECT page_id, {_PATH} p FROM pages), t AS (SELECT page_id, CASE WHEN instr(p, '/a/') > 0 THEN substr(p, instr(p, '/a/') + 3) ELSE p END t FROM p), s AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(t, '\\.html?$', ''), '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') s FROM t) SELECT page_id, CASE WHEN s <> '' THEN s ELSE 'index' END || '.html' slug FROM s",
    "crawl_scope": "SELECT page_id, starts_with(url, 'https://') AND regexp_matches(lower(regexp_replace(regexp_replace(url, '#.*$', ''), '\\?.*$', '')), '\\.html?$') ok, regexp_replace(url, '#.*$', '') bare FROM pages",
    "upsert_merge": "SELECT doc_id, lang, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END::BIGINT AS version FROM documents UNION ALL SELECT doc_id + 1000000000, lang, 2::BIGINT FROM documents WHERE doc_id % 10 = 0",
    "first_match_rank": f"WITH {CORPUS}, {_phrases(BENCH)}, {KLEG} SELECT query_id, min(rank) FILTER (WHERE contains(lower(text), 'idiot') OR contains(lower(text), 'license')) rank FROM bl JOIN documents USING (doc_id) WHERE rank <= 10 GROUP BY query_id",
    "recall_mrr": BEST + " SELECT 'keyword_only' AS mode, count(*) n, " + ", ".join(f"round(avg(CASE WHEN rank <= {k} THEN 1.0 ELSE 0.0 END), 6) recall_{k}" for k in (1, 3, 5, 10)) + ", round(avg(coalesce(1.0 / rank, 0)), 6) mrr FROM best",
    "recall_by_category": BEST + " SELECT coalesce(category, 'overall') category, count(*) n, round(avg(coalesce(1.0 / rank, 0)), 6) mrr FROM (SELECT *, CASE WHEN query_id % 2 = 0 THEN 'single' ELSE 'cross' END category FROM best) GROUP BY GROUPING SETS ((), (category))",
    "ndcg": POOLED + " SELECT query_id, mode, round(set_recall, 6) set_recall, round(ndcg, 6) ndcg, gold_n, pool_n FROM u",
    "pool_stats": POOLED + " SELECT mode, count(set_recall) n, round(avg(set_recall), 6) set_recall, round(avg(ndcg), 6) ndcg, round(avg(pool_n), 6) pool, round(avg(gold_n), 6) gold FROM u GROUP BY mode",
    "pool_empty_modes": POOLED.replace("qr AS (", "few AS (SELECT * FROM modes WHERE mode <> 'keyword_only' OR query_id % 5 <> 0), qr AS (").replace("FROM modes)", "FROM few)").replace("FROM modes JOIN", "FROM few JOIN")
    + " SELECT mode, count(set_recall) n, round(avg(set_recall), 6) set_recall, round(avg(ndcg), 6) ndcg, round(avg(pool_n), 6) pool, round(avg(gold_n), 6) gold FROM u GROUP BY mode",
    "latency_percentiles": "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) i, count(*) OVER (PARTITION BY event_type) n FROM events WHERE value IS NOT NULL) SELECT event_type, any_value(n) n, min(value) FILTER (WHERE i = least(n, greatest(round_even(0.5::DOUBLE * n, 0), 1))) p50, min(value) FILTER (WHERE i = least(n, greatest(round_even(0.95::DOUBLE * n, 0), 1))) p95 FROM r GROUP BY event_type",
    "routing_accuracy": "WITH s AS (SELECT user_id, list_sort(list_distinct(list(event_type))) c, list_sort(list_distinct(coalesce(list(event_type) FILTER (WHERE event_id % 3 <> 0), []))) e FROM events GROUP BY user_id) SELECT count(*) n, round(avg(CASE WHEN c = e THEN 1.0 ELSE 0.0 END), 6) accuracy FROM s",
    "judge_means": "WITH m AS (SELECT event_type, count(*) n, coalesce(avg(nullif(event_id % 6, 0)), 0) a, coalesce(avg(nullif(user_id % 6, 0)), 0) b, coalesce(avg(nullif((event_id + user_id) % 6, 0)), 0) c FROM events GROUP BY 1) SELECT event_type, n, round(a, 6) correctness, round(b, 6) groundedness, round(c, 6) citation_quality, round(coalesce(list_avg(list_filter([a, b, c], lambda x: x > 0)), 0), 6) quality FROM m",
    "cost_usd": USAGE + " SELECT conv_id, round((3.0::DOUBLE * ti + 15.0::DOUBLE * o + 3.75::DOUBLE * cw + 0.3::DOUBLE * cr) / 1e6, 6) usd FROM u",
    "cache_hit_ratio": USAGE + " SELECT conv_id, CASE WHEN cr + ti + cw > 0 THEN round(cr / (cr + ti + cw), 6) ELSE 0.0 END ratio FROM u",
    "event_reduce": "SELECT conv_id, sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, text), '')) answer_sha, count(*) FILTER (WHERE role <> 'assistant') steps, false done FROM conversations GROUP BY conv_id",
    "json_judge_parse": "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 0 ELSE least(5, event_id % 8) END correctness, CASE WHEN event_id % 5 = 0 THEN 0 ELSE user_id % 6 END groundedness, 0::BIGINT citation_quality FROM events",
    "chunk_id_uuid5": "WITH h AS (SELECT doc_id, sha1(unhex('1b9d6bcdbbfd4b2d9b5dab8dfbbd4bed') || encode(doc_id || ':0')) h FROM documents) SELECT doc_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab', (('0x' || h[17:17])::INT & 3) + 1, 1) || h[18:20] || '-' || h[21:32] id FROM h",
    "crawl_bfs": "WITH RECURSIVE b AS (SELECT page_id i, 0 depth, '' AS path FROM pages WHERE page_id = 0 UNION ALL SELECT p.page_id, depth + 1, path || k FROM b, (VALUES (1), (2)) s(k) JOIN pages p ON p.page_id = 2 * b.i + k WHERE depth < 60), r AS (SELECT i, row_number() OVER (ORDER BY depth, path) place FROM b) SELECT 'https://h/s/p' || i || '.html' url, 'p' || i doc_id, place FROM r WHERE place <= 60",
    "windowed_events": "SELECT epoch(time_bucket(INTERVAL 1 hour, ts))::BIGINT start_s, event_type, count(*) n FROM events GROUP BY ALL",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__.removesuffix("_q"): f
    for f in (
        bm25_topk, bm25_scan, bm25_scoped, bm25_phrase, bm25_multi_query, bm25_after_upsert, token_doc_freq, corpus_stats, content_tokens, cosine_topk, cosine_filtered, cosine_multi_query,
        cosine_after_upsert, vector_lists, bucket_upsert, markdown_blocks, judge_prompts, first_per_product, semantic_units, align_judgments, oov_summary, stream_reduce, tool_trace,
        rrf_fuse, weighted_fuse, adaptive_fuse, pool_tail, hybrid_modes, rerank_floor, lexical_router, count_by_product, distinct_topics, document_rebuild, reconcile,
        clean_heading, slug_for_url, crawl_scope, upsert_merge, first_match_rank, recall_mrr, recall_by_category, ndcg, pool_stats, pool_empty_modes, latency_percentiles,
        routing_accuracy, judge_means, cost_usd, cache_hit_ratio, event_reduce, json_judge_parse, chunk_id_uuid5, html_blocks_q, html_chunks, page_facts_q, crawl_bfs, windowed_events,
    )
}
