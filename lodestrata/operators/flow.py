"""Order operators: the section at each block, and islands of text between breaks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FLOWING = ["text", "register"]
BREAKING = ["table", "figure", "bitmap"]


def section_at_block(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """blocks (source, page, block_ord, heading_ord, ...) with section_ord: the last heading on the page so far, else the page's section."""
    so_far = Window.partitionBy("source", "page").orderBy("block_ord").rowsBetween(Window.unboundedPreceding, 0)
    joined = blocks.join(pages.select("source", "page", F.col("toc_ord").alias("page_ord")), ["source", "page"], "left")
    return joined.withColumn("section_ord", F.coalesce(F.last("heading_ord", ignorenulls=True).over(so_far), "page_ord"))


def islands(blocks: DataFrame) -> DataFrame:
    """Text and register blocks with island: the number of their run of one kind and section.

    A run ends where the section changes, also by a page's own section at the page's beginning, where the kind changes between text and
    register, and at a table, figure or bitmap. It goes on over page ends, and definitions do not end it.
    """
    order = Window.partitionBy("source").orderBy("page", "block_ord")
    none = F.lit(-1)
    seen = blocks.filter(F.col("kind") != "definition")
    section = F.coalesce("section_ord", none)
    page_section = F.coalesce("page_ord", none)
    last_section, last_kind, last_page = F.lag(section).over(order), F.lag("kind").over(order), F.lag("page").over(order)
    turned = (last_page != F.col("page")) & (page_section != last_section)
    stop = last_kind.isNull() | (section != last_section) | turned | (F.col("kind") != last_kind) | F.col("kind").isin(BREAKING)
    numbered = seen.withColumn("stop", stop.cast("int")).withColumn("island", F.sum("stop").over(order))
    return numbered.filter(F.col("kind").isin(FLOWING)).drop("stop")


def flow_text(runs: DataFrame, text: str = "text") -> DataFrame:
    """One row per island: its text by line, first and last page, section and kind."""
    line = F.struct("page", "block_ord", F.col(text).alias("t"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["t"]), "\n")
    return runs.groupBy("source", "island").agg(F.min("page").alias("page_start"), F.max("page").alias("page_end"), F.first("section_ord", ignorenulls=True).alias("section_ord"), F.min("kind").alias("kind"), F.count("*").alias("n_blocks"), joined.alias("raw_text"))
