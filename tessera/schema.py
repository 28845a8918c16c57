"""Fixed schemas of the engine's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CHUNK = "id string, product string, doc_id string, chunk_index int, text string, section_path array<string>, source_url string"
DOCUMENT = "id string, product string, title string, source_url string, full_text string"
RECORD = "product string, doc_id string, title string, source_url string, format string, file string"
QUESTION = "id string, question string, expected_products array<string>, expected_section_keywords array<string>, notes string, tag string"
MANIFEST = (
    "products map<string, struct<label: string, collection: string, release: string, fetch_mode: string, "
    "documents: array<struct<doc_id: string, title: string, url: string>>, services: array<struct<name: string, seed_url: string, path_prefix: string>>, "
    "crawl: struct<host_prefix: string, max_pages_per_service: int>>>"
)
JUDGMENT = "correctness string, groundedness string, citation_quality string, rationale string"
PRODUCTS = ("erp", "epm", "oci")


def create_if_absent(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at this path, made empty if there is none; one of other columns or types is an error."""
    want = StructType.fromDDL(schema)
    jp = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jp.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(jp, "_SUCCESS")):
        spark.createDataFrame([], want).coalesce(1).write.mode("overwrite" if fs.exists(jp) and not fs.listStatus(jp) else "errorifexists").parquet(path)
    found = spark.read.parquet(path)
    if [(f.name, f.dataType) for f in found.schema.fields] != [(f.name, f.dataType) for f in want.fields]:
        raise ValueError(f"{path} has the columns {found.schema.simpleString()}")
    return found


def chunk_errors(products: tuple[str, ...] | None = PRODUCTS) -> Column:
    """Names of the chunk columns that break a rule, in column order; empty if the row is valid."""
    blank = lambda c: F.coalesce(F.length(c), F.lit(0)) == 0
    rules = [(c, blank(c)) for c in ("id", "doc_id", "text", "source_url")]
    rules.append(("product", blank("product") if products is None else ~F.coalesce(F.col("product").isin(*products), F.lit(False))))
    rules.append(("chunk_index", F.coalesce(F.col("chunk_index") < 0, F.lit(True))))
    return F.filter(F.array(*(F.when(bad, F.lit(name)) for name, bad in rules)), lambda x: x.isNotNull())


def validate_chunks(df: DataFrame, products: tuple[str, ...] | None = PRODUCTS, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and rejected ones with their errors. Unknown columns are refused; strict raises on any bad row."""
    known = {c.split()[0] for c in CHUNK.split(", ")}
    if extra := set(df.columns) - known:
        raise ValueError(f"unknown columns: {sorted(extra)}")
    marked = df.withColumn("errors", chunk_errors(products))
    bad = marked.where(F.size("errors") > 0)
    if strict and (row := bad.first()):
        raise ValueError(f"invalid chunk {row.id}: {row.errors}")
    return marked.where(F.size("errors") == 0).drop("errors"), bad
