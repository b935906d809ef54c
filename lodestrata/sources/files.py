"""File sources and sinks: chunk records, questions, responses, page models, binary documents, reports."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..plugins import Decoder
from ..schema import CHUNK, PAGE, QUESTION, RESPONSE, TOC


def read_chunks(spark: SparkSession, path: str, validated: bool = True) -> tuple[DataFrame, DataFrame]:
    """(chunks, malformed lines) of JSON lines files, with the file of each. Blank lines are skipped.

    validated=False: fields that are absent get their defaults, and text falls back to the raw text; lines that are no JSON are malformed either way.
    """
    bad = "_malformed"
    schema = T.StructType([*CHUNK.fields, T.StructField(bad, T.StringType())])
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", bad).option("pathGlobFilter", "*.json*").json(path)
    rows = rows.withColumn("file", F.col("_metadata.file_name"))
    broken = F.col(bad).isNotNull()
    if validated:
        broken = broken | F.col("source").isNull() | F.col("content_type").isNull() | F.col("text").isNull()
    blank = F.coalesce(F.trim(F.col(bad)) == "", F.lit(False))
    good = rows.filter(~broken).drop(bad)
    defaults = {"section_path": F.array().cast("array<string>"), "section_title": F.lit(""), "heading_level": F.lit(0), "is_front_matter": F.lit(False), "chunk_index": F.lit(0), "raw_text": F.lit(""), "is_row_chunk": F.lit(False)}
    good = good.withColumns({k: F.coalesce(F.col(k), v) for k, v in defaults.items()})
    if not validated:
        good = good.withColumn("text", F.coalesce("text", "raw_text"))
    return good, rows.filter(broken & ~blank).select("file", bad)


def write_chunks(chunks: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One folder per source, JSON lines in UTF-8, front matter too."""
    chunks.withColumn("file_source", F.col("source")).write.mode(mode).partitionBy("file_source").json(path)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions; a malformed line is an error."""
    return spark.read.schema(QUESTION).option("mode", "FAILFAST").json(path)


def write_responses(responses: DataFrame, path: str, mode: str = "errorifexists") -> None:
    responses.select(*RESPONSE.fieldNames(), *[c for c in ("pipeline",) if c in responses.columns]).write.mode(mode).json(path)


def _decoded(spark: SparkSession, path: str, pattern: str, schema: T.StructType, rows: Callable[[str, bytes], Iterator[dict]]) -> DataFrame:
    """The rows that a decoder gives for each file, in the tasks that read it; fields it does not give are null."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    names = schema.fieldNames()

    def decode(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = [{k: r.get(k) for k in names} | {"source": name} for r in rows(name, content)]
                if found:
                    yield from pa.Table.from_pylist(found, schema=arrow).to_batches()

    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content").mapInArrow(decode, schema)


def read_documents(spark: SparkSession, path: str, decoder: Callable[[], Decoder], pattern: str = "*.pdf", schema: T.StructType = PAGE) -> DataFrame:
    """The page models of binary documents (schema=RAW_PAGE: what was found on their pages, for pages.page_models). A missing path is an error."""
    pages = _decoded(spark, path, pattern, schema, lambda name, content: decoder().pages(name, content))
    return pages.withColumn("version", F.coalesce("version", X.file_version(F.col("source"))))


def read_toc(spark: SparkSession, path: str, decoder: Callable[[], Decoder], pattern: str = "*.pdf", page_offset: int = 1) -> DataFrame:
    """schema.TOC of binary documents: their outlines' entries in order, page_offset added to the decoder's page numbers (1: it counts from 0)."""

    def rows(name: str, content: bytes) -> Iterator[dict]:
        for i, (level, title, page) in enumerate(decoder().outline(name, content)):
            yield {"toc_ord": i, "level": level, "title": title, "page_start": page + page_offset}

    return _decoded(spark, path, pattern, TOC, rows)


def blocks(pages: DataFrame, kind: str) -> DataFrame:
    """The blocks of one kind of page models, a row each with block_ord from 0."""
    # outer, its empty pages left out after it: before the inner one Spark puts a filter on the list's size, which makes each page's blocks a second time
    every = pages.select("source", "version", F.col("page_num").alias("page"), "width", "height", F.posexplode_outer(kind).alias("block_ord", "b"))
    return every.filter(F.col("block_ord").isNotNull()).select("source", "version", "page", "width", "height", "block_ord", "b.*")


def html_blocks(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """(page, block_ord, tag, text): headings, paragraphs and list items of web pages, in order, with their markup removed."""
    pattern = r"(?is)<(h1|h2|p|li)\b[^>]*>(.*?)(?=</\1>|<(?:h1|h2|p|li|/article|/ul|/body)\b)"
    tags = F.regexp_extract_all(F.col(html), F.lit(pattern), F.lit(1))
    bodies = F.regexp_extract_all(F.col(html), F.lit(pattern), F.lit(2))
    rows = pages.select(F.col(key).alias("page"), F.posexplode(F.arrays_zip(tags.alias("t"), bodies.alias("b"))).alias("block_ord", "x"))
    return rows.select("page", "block_ord", F.lower("x.t").alias("tag"), F.trim(F.regexp_replace(F.regexp_replace("x.b", "<[^>]*>", " "), r"[ \t\r\n]+", " ")).alias("text"))


def write_report(spark: SparkSession, lines: list[str], path: str) -> None:
    """A Markdown file of bounded size, through the file system that Spark sees."""
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.mode("overwrite").option("lineSep", "\n").text(path)


def column_or_null(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)
