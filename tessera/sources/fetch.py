"""Manifests, fetched records, offline crawling, resilient multi-document scans, datasets and reports."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.text import chunk_id, in_scope, slug_for_url, urldefrag
from tessera.functions.seams import with_retry
from tessera.operators.chunking import TokenCounter, html_blocks, pack_chunks, page_facts, pdf_blocks, pieces, text_blocks
from tessera.schema import CHUNK, MANIFEST, QUESTION, RECORD
from tessera.session import discard, materialize


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(product, label, collection, release, fetch_mode, documents, services, crawl), one row for each product."""
    return spark.read.schema(MANIFEST).json(path, multiLine=True).select(F.explode("products").alias("product", "p")).select("product", "p.*")


def manifest_documents(manifest: DataFrame) -> DataFrame:
    return manifest.select("product", F.explode("documents").alias("d")).select("product", "d.*")


def manifest_services(manifest: DataFrame) -> DataFrame:
    return manifest.select("product", "crawl", F.explode("services").alias("s")).select("product", "crawl", "s.*")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Fetched records of a product; a missing file is an empty table."""
    try:
        return spark.read.schema(RECORD).json(path, multiLine=True)
    except AnalysisException:
        return spark.createDataFrame([], RECORD)


def read_pdf_files(spark: SparkSession, path: str) -> DataFrame:
    """Already fetched PDFs as (path, length, content), empty files skipped."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path).where("length > 0").select("path", "length", "content")


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of evaluation questions; blank lines are skipped, malformed ones fail."""
    return spark.read.schema(QUESTION).option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_records(records: DataFrame, path: str) -> None:
    """One JSON file of a product's fetched records (as many as a crawl's cap)."""
    records.coalesce(1).write.mode("overwrite").json(path)


def select_questions(questions: DataFrame, ids: list[str] | None = None, category: str | None = None, limit: int | None = None) -> DataFrame:
    """By ids, then category, then the first `limit` in id order; empty values are no filter."""
    if ids:
        questions = questions.where(F.col("id").isin(*ids))
    if category:
        questions = questions.where(F.col("category") == category)
    return questions.orderBy("id").limit(limit) if limit else questions


def semantic_units(questions: DataFrame) -> DataFrame:
    """One row for each question and expected product, without exact terms and adversarial ones."""
    plain = (F.coalesce("tag", F.lit("")) != "exact_term") & ~F.col("id").startswith("adv-")
    return questions.where(plain).withColumn("product", F.explode("expected_products"))


def expand_modes(units: DataFrame, modes: list[str]) -> DataFrame:
    """Each unit once for each mode."""
    return units.withColumn("mode", F.explode(F.array(*map(F.lit, modes))))


def crawl(pages: DataFrame, seed: str, host_prefix: str, path_prefix: str, cap: int, marker: str = "/Content/") -> DataFrame:
    """Bounded breadth-first crawl over an offline table of pages (url, html): product of a fetch without network.

    (url, doc_id, title, html, place). Levels are joins of the frontier with the pages, less what
    was visited; order is by level and by where a link was queued. The cap counts saved pages, so a
    level is cut when it is full; pages that are missing are visited but not saved.
    """
    facts = materialize(page_facts(pages.select(urldefrag(F.col("url")).alias("url"), "html").dropDuplicates(["url"]), "url"), "facts")
    spark = pages.sparkSession
    frontier = spark.createDataFrame([(urldefrag_py(seed), 0)], "url string, at long")
    visited = frontier.select("url")
    saved, n = None, 0
    while n < cap:
        # The sort's limit comes first, so that the numbering sees what the cap leaves and no more.
        got = frontier.join(facts, "url").orderBy("at").limit(cap - n).withColumn("place", F.row_number().over(W.orderBy("at")) + n)
        got = materialize(got, "crawled")  # at most `cap` rows
        level = got.count()
        if not level:
            break
        n += level
        saved = got if saved is None else saved.unionByName(got)
        links = got.select("place", F.posexplode("links").alias("no", "url")).where(in_scope(F.col("url"), host_prefix, path_prefix))
        links = links.groupBy("url").agg(F.min(F.col("place") * 1_000_000 + F.col("no")).alias("at"))
        frontier = materialize(links.join(visited, "url", "left_anti"), "frontier")
        before, visited = visited, materialize(visited.union(frontier.select("url")), "visited")
        discard(before)
    if saved is None:
        return facts.where("false").select("url", F.lit("").alias("doc_id"), "title", F.lit("").alias("html"), F.lit(0).alias("place"))
    body = pages.select(urldefrag(F.col("url")).alias("url"), "html").dropDuplicates(["url"])
    return saved.join(body, "url").select("url", F.regexp_replace(slug_for_url(F.col("url"), marker), r"\.html$", "").alias("doc_id"), "title", "html", "place")


def urldefrag_py(url: str) -> str:
    return url.split("#", 1)[0]


def _limited(records: DataFrame, limit_docs: int | None) -> DataFrame:
    if not limit_docs:
        return records
    return records.withColumn("__n", F.row_number().over(W.partitionBy("product").orderBy("doc_id"))).where(F.col("__n") <= limit_docs).drop("__n")


def _kinds(records: DataFrame) -> dict[str, DataFrame]:
    keyed = records.withColumn("__key", F.to_json(F.struct("product", "doc_id", "source_url"), {"ignoreNullFields": "false"}))
    kinds = {"html": ("html", "htm"), "text": ("md", "txt", "text"), "pdf": ("pdf",)}
    out = {k: keyed.where(F.lower("format").isin(*names)) for k, names in kinds.items()}
    every = [x for names in kinds.values() for x in names]
    return out | {"other": keyed.where(~F.coalesce(F.lower("format").isin(*every), F.lit(False)))}


_FACTS = "product string, doc_id string, source_url string"


def collect_chunks(records: DataFrame, limit_docs: int | None = None, least: int = 400, most: int = 800, tokens: TokenCounter = pieces, spans: DataFrame | None = None) -> DataFrame:
    """Chunks of records that carry their content (product, doc_id, source_url, format, content), by format: html, plain
    text, and pdf by its spans (product, doc_id and what pdf_blocks reads). The limit is per product. A document that
    can't be read has no chunks and does not stop the others; collect_errors tells why."""
    kinds = _kinds(_limited(records, limit_docs))
    text = text_blocks(kinds["text"], "__key", "content")
    blocks = html_blocks(kinds["html"], "__key", "content").unionByName(text.withColumn("block_no", F.col("block_no").cast("int")))
    if spans is not None:
        blocks = blocks.unionByName(pdf_blocks(spans.join(kinds["pdf"].select("product", "doc_id", "__key"), ["product", "doc_id"]), "__key"))
    out = pack_chunks(blocks, "__key", least, most, tokens).withColumn("k", F.from_json("__key", _FACTS))
    columns = [c.split()[0] for c in CHUNK.split(", ")]
    out = out.select("k.*", "chunk_index", "text", "section_path").withColumn("id", chunk_id(F.col("doc_id"), F.col("chunk_index")))
    return out.select(*columns)


def collect_errors(records: DataFrame, limit_docs: int | None = None, spans: DataFrame | None = None) -> DataFrame:
    """(product, doc_id, error) of the records that collect_chunks can't read: pages that don't parse, PDFs without spans, other formats, no content."""
    kinds = _kinds(_limited(records, limit_docs))
    blank = lambda df: df.where(F.coalesce(F.length("content"), F.lit(0)) == 0).select("__key", F.lit("no content").alias("error"))
    pages = page_facts(kinds["html"].withColumn("url", F.lit("")), "__key", html="content").where("error is not null").select("__key", "error")
    pdf = kinds["pdf"] if spans is None else kinds["pdf"].join(spans.select("product", "doc_id").distinct(), ["product", "doc_id"], "left_anti")
    other = kinds["other"].select("__key", F.concat(F.lit("unknown format "), F.coalesce("format", F.lit("null"))).alias("error"))
    found = pages.union(blank(kinds["html"])).union(blank(kinds["text"])).union(pdf.select("__key", F.lit("no spans"))).union(other)
    return found.select(F.from_json("__key", _FACTS).alias("k"), "error").select("k.product", "k.doc_id", "error")


def dry_run(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("product").agg(F.count("*").alias("n"))


def fetch_urls(wanted: DataFrame, get: Callable[[str], bytes], have: DataFrame | None = None, limit: int | None = None, force: bool = False, retryable: tuple[type[Exception], ...] = (TimeoutError, ConnectionError), attempts: int = 3, wait: float = 0.5) -> DataFrame:
    """(product, doc_id, url, content, error) of documents (product, doc_id, url) by a provider's `get`.

    Retryable errors are tried again after growing waits, up to `attempts` calls in all.

    Documents that `have` (product, doc_id, content) holds with content are skipped unless forced;
    the limit is per product, in doc_id order. A failed fetch is a row with an error, not an abort.
    """
    if limit:
        wanted = wanted.withColumn("__n", F.row_number().over(W.partitionBy("product").orderBy("doc_id"))).where(F.col("__n") <= limit).drop("__n")
    if have is not None and not force:
        wanted = wanted.join(have.where(F.length("content") > 0).select("product", "doc_id"), ["product", "doc_id"], "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got: list[tuple[bytes | None, str | None]] = []
            for url in b["url"]:
                try:
                    got.append((with_retry(lambda url=url: get(url), retryable, attempts, wait), None))
                except Exception as e:  # noqa: BLE001 - any provider error becomes a row
                    got.append((None, f"{type(e).__name__}: {e}"))
            yield b.assign(content=[c for c, _ in got], error=[e for _, e in got])

    return wanted.select("product", "doc_id", "url").mapInPandas(run, "product string, doc_id string, url string, content binary, error string")
