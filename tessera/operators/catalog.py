"""Store operations: counts, topics, documents, upserts, and the check of the two stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.text import clean_heading, title_fallback


def count_by_product(chunks: DataFrame, product: str = "product") -> DataFrame:
    return chunks.groupBy(product).agg(F.count("*").alias("n"))


def list_topics(chunks: DataFrame, path: str = "section_path") -> DataFrame:
    """Distinct cleaned top headings in order."""
    return chunks.where(F.size(path) > 0).select(clean_heading(F.col(path)[0]).alias("topic")).where("topic <> ''").distinct().orderBy("topic")


def rebuild_documents(chunks: DataFrame, doc: str = "doc_id", order: str = "chunk_index", text: str = "text", sep: str = "\n\n") -> DataFrame:
    """(doc, full_text, n_chunks): texts joined in chunk order."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order), F.col(text))))
    return chunks.groupBy(doc).agg(F.array_join(F.transform(parts, lambda x: x[text]), sep).alias("full_text"), F.count("*").alias("n_chunks"))


def get_document(chunks: DataFrame, doc_id: str | None = None) -> DataFrame:
    """doc_id, product, title (first path's top heading, else from the id), source_url and full_text; of one document or of all."""
    rows = chunks.where(F.col("doc_id") == doc_id) if doc_id is not None else chunks
    first = lambda c: F.min_by(c, "chunk_index")
    parts = F.array_sort(F.collect_list(F.struct("chunk_index", "text")))
    docs = rows.groupBy("doc_id").agg(
        first("product").alias("product"), first("section_path").alias("path"), first("source_url").alias("source_url"), F.array_join(F.transform(parts, lambda x: x["text"]), "\n\n").alias("full_text")
    )
    return docs.select("doc_id", "product", F.when(F.size("path") > 0, F.col("path")[0]).otherwise(title_fallback(F.col("doc_id"))).alias("title"), "source_url", "full_text")


def upsert(old: DataFrame, new: DataFrame, key: str = "id", order: Column | None = None, replace: str | None = None) -> DataFrame:
    """old with new's rows in place of those of the same key; of several new rows of a key the last in `order` wins.

    Keys that are gone from new stay, as in an upsert; with `replace` (a document column) all
    old rows of a document that new holds go first. Without a lakehouse format the caller
    writes the result beside the old table and swaps them.
    """
    if order is not None:
        new = new.withColumn("__n", F.row_number().over(W.partitionBy(key).orderBy(order.desc()))).where("__n = 1").drop("__n")
    else:
        new = new.dropDuplicates([key])
    kept = old.join(new.select(key), key, "left_anti")
    if replace:
        kept = kept.join(new.select(replace).distinct(), replace, "left_anti")
    return kept.select(*old.columns).unionByName(new.select(*old.columns))


def reconcile(chunks: DataFrame, vectors: DataFrame, by: str = "product") -> DataFrame:
    """(by, n_chunks, n_vectors, status): OK where the two stores hold equally many."""
    a = chunks.groupBy(by).agg(F.count("*").alias("n_chunks"))
    b = vectors.groupBy(by).agg(F.count("*").alias("n_vectors"))
    both = a.join(b, by, "full_outer").na.fill(0, ["n_chunks", "n_vectors"])
    return both.withColumn("status", F.when(F.col("n_chunks") == F.col("n_vectors"), "OK").otherwise("MISMATCH"))


def first_per_group(df: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """The first n rows of each group: limits per product."""
    return df.withColumn("__n", F.row_number().over(W.partitionBy(group).orderBy(order))).where(F.col("__n") <= n).drop("__n")
