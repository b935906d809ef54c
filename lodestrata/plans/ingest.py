"""From page models and tables of contents to chunk records: the whole ingest as one plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import chunks as C
from ..operators import flow, layout, structure, tables
from ..plugins import Decoder
from ..profile import CAPTION_MARGIN, DEFAULT, DEFINITION_PARTS, FIGURE_AREA, Profile
from ..schema import RAW_PAGE
from ..session import stored
from ..sources.files import blocks, read_documents, read_toc
from ..sources.pages import page_models

PAGE = ["source", "page"]


def ingest(pages: DataFrame, toc: DataFrame, header_mode: str = "fixed", profile: Profile = DEFAULT, keep: Callable[[DataFrame], DataFrame] = DataFrame.persist, cleaned: bool = False) -> DataFrame:
    """Chunks of all documents. pages: schema.PAGE; toc: schema.TOC (source, toc_ord, level, title, page_start).

    cleaned: the pages come from pages.page_models, so texts and tables are clean and chosen already.

    keep: what to do with the few tables that several kinds of chunks are made of (blocks, sections); they are used again.
    Every step is a join or window keyed by source and page, so documents are independent and none is held in memory.
    """
    last = pages.groupBy("source").agg(F.max("page_num").alias("total_pages"))
    secs = structure.sections(toc.join(last, "source"), profile=profile)
    secs = keep(secs)
    places = keep(structure.page_sections(secs))
    versions = pages.select("source", "version").distinct()

    texts, grids = blocks(pages, "text_blocks"), blocks(pages, "table_blocks")
    if not cleaned:
        texts = texts.withColumn("text", X.clean_text(F.col("text"), profile)).filter("text <> ''")
        texts = texts.filter(~layout.in_margin(F.col("y0"), F.col("y1"), F.col("height")))
        grids = grids.filter(tables.is_plausible(F.col("rows"))).withColumn("rows", tables.drop_noise(F.col("rows"), profile)).filter(F.size("rows") > 0)
    texts = keep(texts)
    drawings = blocks(pages, "drawing_clusters").filter((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) >= FIGURE_AREA)
    images = blocks(pages, "image_blocks")

    # a page's blocks in order, with kinds by the section at the page's start
    titles = places.join(secs.select("source", "toc_ord", F.col("title").alias("page_title")), ["source", "toc_ord"]).select(*PAGE, "page_title")
    own = texts.join(titles, PAGE, "left")
    ordered = layout.classify(own, grids, drawings, images, PAGE, F.coalesce("page_title", F.lit("")))
    keyed = ordered.withColumn("block_id", F.concat_ws(":", "page", "block_ord"))
    placed = structure.headings(keyed, secs, profile=profile)
    placed = placed.withColumn("heading_ord", F.when(F.col("kind") == "text", F.col("heading_ord")))
    placed = keep(flow.section_at_block(placed, places).drop("block_id"))

    runs = flow.flow_text(flow.islands(placed)).join(versions, "source")
    out = C.text_chunks(C.attach_section(runs, secs), profile)

    at = placed.select(*PAGE, "kind", "own_ord", "section_ord")
    page_text = texts.groupBy(*PAGE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_ord", "text"))), lambda b: b["text"]), "\n").alias("t"))
    captions = page_text.select(*PAGE, X.table_caption(F.col("t")).alias("caption"))
    t = grids.withColumnRenamed("block_ord", "own_ord").join(at.filter("kind = 'table'"), [*PAGE, "own_ord"]).join(captions, PAGE, "left")
    t = t.withColumns({"page_start": F.col("page"), "page_end": F.col("page")})
    out = out.unionByName(C.table_chunks(tables.preprocess(C.attach_section(t, secs), header_mode=header_mode), profile))

    for kind, rows, grow in (("figure", drawings, 0.0), ("bitmap", images, CAPTION_MARGIN)):
        f = rows.withColumnRenamed("block_ord", "own_ord")
        near = layout.nearest_caption(f, texts, PAGE, "own_ord").drop("dist")
        labels = layout.labels_in_boxes(texts, f, PAGE, "own_ord", grow)
        f = f.join(at.filter(F.col("kind") == kind), [*PAGE, "own_ord"]).join(near, [*PAGE, "own_ord"], "left").join(labels, [*PAGE, "own_ord"], "left")
        f = f.withColumns({"page_start": F.col("page"), "page_end": F.col("page")})
        out = out.unionByName(C.figure_chunks(C.attach_section(f, secs), profile))

    lines = F.transform(F.array_sort(F.collect_list(F.struct("page", "block_ord", "text"))), lambda b: b["text"])
    defs = placed.filter("kind = 'definition'").groupBy("source", "section_ord").agg(F.min("page").alias("page_start"), F.max("page").alias("page_end"), F.array_join(lines, " \n").alias("raw_text"))
    return out.unionByName(C.definition_chunks(C.attach_section(defs.join(versions, "source"), secs), profile))


def ingest_documents(spark: SparkSession, path: str, decoder: Callable[[], Decoder], pattern: str = "*.pdf", page_offset: int = 1, **options) -> DataFrame:
    """Chunks of a folder's documents, from what the decoder finds on their pages (schema.RAW_PAGE) and from their own outlines.

    Page models and the tables that several kinds of chunks are made of are written once, so that no document is decoded twice.
    """
    keep = stored(spark, "ingest")
    raw = read_documents(spark, path, decoder, pattern, RAW_PAGE)
    pages = keep(page_models(raw, options.get("profile", DEFAULT)))
    return ingest(pages, read_toc(spark, path, decoder, pattern, page_offset), cleaned=True, **{"keep": keep, **options})


def lost_definition_blocks(placed: DataFrame, secs: DataFrame) -> DataFrame:
    """Sections whose title holds a definition word but is not a definition title: their blocks on such pages give no chunk."""
    from ..profile import DEFINITION_TITLES

    title = F.lower(F.trim("title"))
    odd = secs.filter(title.rlike("|".join(DEFINITION_PARTS)) & ~title.isin(DEFINITION_TITLES)).select("source", F.col("toc_ord").alias("section_ord"), "title")
    return placed.filter("kind = 'definition'").join(odd, ["source", "section_ord"]).groupBy("source", "title").agg(F.count("*").alias("n_blocks"))
