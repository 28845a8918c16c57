"""Table functions for SQL: blocks of pages, and chunks of blocks read in order without a whole document in memory.

    SELECT page_id, b.* FROM pages, LATERAL html_blocks(html) b
    SELECT * FROM pack_chunks(TABLE(SELECT doc_id, block_no, section_path, text FROM blocks) PARTITION BY (doc_id) ORDER BY (block_no), 400, 800)
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, IntegerType, Row, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from tessera.operators.chunking import TokenCounter, pieces, read_blocks, sentence_pieces


class HtmlBlocks:
    """(block_no, section_path, text) of one page; a page that can't be parsed has none."""

    def eval(self, html: str) -> Iterator[tuple[int, list[str], str]]:
        for i, (path, text) in enumerate(read_blocks(html)):
            yield i, list(path), text


class PackChunks:
    """(key, chunk_index, section_path, text) of a document's blocks in order, as `pack_chunks` gives them.

    The key is the table's first column; the others are block_no, section_path and text. What is held is one chunk.
    """

    tokens: TokenCounter = staticmethod(pieces)

    def __init__(self) -> None:
        self.key, self.least, self.most, self.index = None, 400, 800, 0
        self.paths: list[tuple[str, ...]] = []
        self.texts: list[str] = []
        self.size = 0

    @staticmethod
    def analyze(table: AnalyzeArgument, least: AnalyzeArgument, most: AnalyzeArgument) -> AnalyzeResult:
        key = table.dataType.fields[0]
        return AnalyzeResult(StructType().add(key.name, key.dataType).add("chunk_index", IntegerType()).add("section_path", ArrayType(StringType())).add("text", StringType()))

    def eval(self, row: Row, least: int, most: int) -> Iterator[tuple]:
        self.key, self.least, self.most = row[0], least, most
        path, text = tuple(row["section_path"] or ()), row["text"] or ""
        if not text.strip():
            return
        size, joined = len(self.tokens(text)), len(self.tokens("\n\n"))
        if self.texts and (size > most or self.size + joined + size > most or (self.size >= least and path != self.paths[-1])):
            yield from self._flush()
        self.size += size + (joined if self.texts else 0)
        self.paths.append(path)
        self.texts.append(text)
        if size > most:
            yield from self._flush()

    def terminate(self) -> Iterator[tuple]:
        yield from self._flush()

    def _flush(self) -> Iterator[tuple]:
        parts = [] if not self.texts else sentence_pieces(self.texts[0], self.most, self.tokens) if self.size > self.most else ["\n\n".join(self.texts)]
        for part in parts:
            yield self.key, self.index, list(os.path.commonprefix(self.paths)), part
            self.index += 1
        self.paths, self.texts, self.size = [], [], 0


def register_tables(spark: SparkSession) -> None:
    """The functions html_blocks and pack_chunks in this session's SQL."""
    spark.udtf.register("html_blocks", udtf(HtmlBlocks, returnType="block_no int, section_path array<string>, text string"))
    spark.udtf.register("pack_chunks", udtf(PackChunks))


def packed(blocks: DataFrame, key: str = "doc_id", least: int = 400, most: int = 800) -> DataFrame:
    """(key, chunk_index, section_path, text) by the table function."""
    register_tables(blocks.sparkSession)
    rows = blocks.select(key, "block_no", "section_path", "text")
    return blocks.sparkSession.sql(f"SELECT * FROM pack_chunks(TABLE({{rows}}) PARTITION BY (`{key}`) ORDER BY (block_no), {int(least)}, {int(most)})", rows=rows)
