"""Document structure: sections from a table of contents, pages to sections, headings to sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..profile import DEFAULT, FRONT_MATTER, Profile

LEVELS = 6


def section_ends(toc: DataFrame, total_pages: str = "total_pages", levels: int = LEVELS) -> DataFrame:
    """toc (source, toc_ord, level, page_start, total_pages) with page_end.

    A section ends on the page before the next entry of its own or a higher level, and not before it starts; without
    such an entry, on the last page. One window per level over each source, no self-join. Entries deeper than `levels`
    end as those of that level do.
    """
    below = Window.partitionBy("source").orderBy(F.col("toc_ord").desc()).rowsBetween(Window.unboundedPreceding, -1)
    following = [F.last(F.when(F.col("level") <= k, F.col("page_start")), ignorenulls=True).over(below) for k in range(1, levels + 1)]
    chosen = F.get(F.array(*following), F.least(F.col("level"), F.lit(levels)) - 1)
    end = F.when(chosen.isNull(), F.col(total_pages)).otherwise(F.greatest(F.col("page_start"), chosen - 1))
    return toc.withColumn("page_end", end)


def sections(toc: DataFrame, levels: int = LEVELS, profile: Profile = DEFAULT) -> DataFrame:
    """Sections with number, path, title, label, page range and front-matter mark.

    The body starts at the first numbered entry of level 1; without one, at the first of level 1 whose title is not
    one of front matter; else on page 1.
    """
    s = section_ends(toc, levels=levels).withColumnRenamed("title", "toc_title")
    s = s.withColumn("number", X.section_number(F.col("toc_title"))).withColumn("title", X.bare_title(F.col("toc_title")))
    s = s.withColumn("section_path", X.section_path(F.col("number")))
    s = s.withColumn("label", X.section_label(F.col("section_path"), F.col("title")))
    whole = Window.partitionBy("source")
    top = F.col("level") == 1
    front = F.lower(X.trim_all(F.col("toc_title"))).isin(FRONT_MATTER)
    numbered = F.min_by(F.when(top & (F.col("number") != ""), F.col("page_start")), F.when(top & (F.col("number") != ""), F.col("toc_ord"))).over(whole)
    plain = F.min_by(F.when(top & ~front, F.col("page_start")), F.when(top & ~front, F.col("toc_ord"))).over(whole)
    s = s.withColumn("body_start", F.coalesce(numbered, plain, F.lit(1)))
    return s.withColumn("is_front_matter", F.col("page_start") < F.col("body_start")).withColumn("label_key", X.normalize_label(F.col("label"), profile))


def page_sections(secs: DataFrame) -> DataFrame:
    """(source, page, toc_ord): for each page the deepest section that covers it; then the one that starts last, then the last in order."""
    covered = secs.filter("page_end >= page_start").select("source", "toc_ord", "level", "page_start", F.explode(F.sequence("page_start", "page_end")).alias("page"))
    return covered.groupBy("source", "page").agg(F.max_by("toc_ord", F.struct("level", "page_start", "toc_ord")).alias("toc_ord"))


def exact_headings(blocks: DataFrame, secs: DataFrame, text: str = "text", profile: Profile = DEFAULT) -> DataFrame:
    """blocks with toc_ord of the section whose label the text is; the first section of a label counts; null without one."""
    first = secs.filter("label_key <> ''").groupBy("source", "label_key").agg(F.min("toc_ord").alias("exact_ord"))
    keyed = blocks.withColumn("label_key", X.normalize_label(F.col(text), profile))
    return keyed.join(first, ["source", "label_key"], "left")


def prefix_headings(blocks: DataFrame, secs: DataFrame, key: str = "label_key") -> DataFrame:
    """blocks (with block_id) with prefix_ord: of the sections whose label begins the text before a blank, the first in order.

    A text's prefixes are taken at its blanks, up to the longest label's length, and joined on equality.
    """
    first = secs.filter("label_key <> ''").groupBy("source", "label_key").agg(F.min("toc_ord").alias("prefix_ord"))
    longest = first.groupBy("source").agg(F.max(F.length("label_key")).alias("longest"))
    words = F.split(F.col("t"), r"[ \n\t]")
    cuts = (
        blocks.select("source", "block_id", F.col(key).alias("t"))
        .join(longest, "source")
        .withColumn("t", F.expr("left(t, longest + 1)"))
        .select("source", "block_id", F.explode(F.when(F.size(words) > 1, F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.array_join(F.slice(words, 1, i), " ")))).alias("label_key"))
    )
    hits = cuts.join(first, ["source", "label_key"]).groupBy("source", "block_id").agg(F.min("prefix_ord").alias("prefix_ord"))
    return blocks.join(hits, ["source", "block_id"], "left")


def headings(blocks: DataFrame, secs: DataFrame, text: str = "text", profile: Profile = DEFAULT) -> DataFrame:
    """blocks with heading_ord: the exact label's section, else the first whose label begins the text."""
    found = prefix_headings(exact_headings(blocks, secs, text, profile), secs)
    return found.withColumn("heading_ord", F.coalesce("exact_ord", "prefix_ord")).drop("exact_ord", "prefix_ord", "label_key")
