"""Chunk builders: from text runs, tables, figures and definition sections to chunk records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.bind import bound
from ..functions.ids import chunk_id
from ..profile import DEFAULT, DEFINITION_TITLES, TABLE_CHARS, Profile
from ..schema import CHUNK
from .splitter import split_frame
from .tables import row_groups, table_markdowns

BASE = ["source", "version", "page_start", "page_end", "section_path", "section_title", "heading_level", "section_label", "section_front"]


def attach_section(rows: DataFrame, secs: DataFrame, by: str = "section_ord") -> DataFrame:
    """rows with their section's fields; without a section: no path, no title, level 0, front matter."""
    s = secs.select("source", F.col("toc_ord").alias(by), "section_path", F.col("title").alias("section_title"), F.col("level").alias("heading_level"), F.col("label").alias("section_label"), F.col("is_front_matter").alias("section_front"))
    r = rows.join(s, ["source", by], "left")
    return r.withColumns({"section_path": F.coalesce("section_path", F.array().cast("array<string>")), "section_title": F.coalesce("section_title", F.lit("")), "heading_level": F.coalesce("heading_level", F.lit(0)), "section_front": F.coalesce("section_front", F.lit(True))})


def record(rows: DataFrame, kind: Column, raw: Column, prefix: Column, index: Column, **extra: Column) -> DataFrame:
    """Chunk records from rows with the BASE columns."""
    none = F.lit(None).cast("string")
    rows = rows.withColumns({"__kind": kind, "__raw": raw, "__prefix": prefix, "__index": index.cast("int"), **{f"__{k}": v for k, v in extra.items()}})
    front = F.col("__front") if "front" in extra else F.col("section_front")
    get = lambda k, d=none: F.col(f"__{k}") if k in extra else d
    fields = {
        "chunk_id": chunk_id(F.col("source"), F.col("version"), F.col("__kind"), F.col("page_start"), F.col("section_path"), F.col("__index"), F.col("__raw")),
        "content_type": F.col("__kind"), "is_front_matter": front, "chunk_index": F.col("__index"), "text": F.concat("__prefix", "__raw"), "raw_text": F.col("__raw"),
        "table_markdown": get("table_markdown"), "figure_caption": get("caption"), "term": get("term"), "parent_chunk_id": get("parent"), "is_row_chunk": get("is_row", F.lit(False)),
    }
    return rows.select(*[(fields[f.name] if f.name in fields else F.col(f.name)).cast(f.dataType).alias(f.name) for f in CHUNK.fields])


def _prefix(profile: Profile) -> Column:
    return X.context_prefix(F.col("version"), F.col("section_label"), F.col("page_start"), profile.product)


def text_chunks(runs: DataFrame, profile: Profile = DEFAULT) -> DataFrame:
    """Chunks of text and register runs (BASE, kind, raw_text)."""
    parts = split_frame(runs, "raw_text", F.col("kind"))
    return record(parts, F.col("kind"), F.col("chunk"), _prefix(profile), F.col("chunk_index"))


def table_chunks(tables: DataFrame, profile: Profile = DEFAULT, limit: int = TABLE_CHARS) -> DataFrame:
    """Full-table and row-group chunks of preprocess()ed tables (BASE, caption, header, body, notes).

    A table's caption is the first of its page. Row groups name the first full chunk of their table as parent. Both kinds
    come from one pass over the tables.
    """
    caption = F.coalesce("caption", F.lit(""))
    t = bound(tables, cap=F.nullif(caption, F.lit("")), p=_prefix(profile))
    prefix = F.concat(F.expr("substring(p, 1, length(p) - 1)"), F.lit("\n"), F.coalesce(F.concat("cap", F.lit("\n")), F.lit("")), F.lit("\n"))
    t = table_markdowns(bound(t, p=prefix), F.col("p"), limit)
    register = F.coalesce(F.col("cap"), F.nullif(F.col("section_title"), F.lit("")), F.lit("Register"))
    parent = chunk_id(F.col("source"), F.col("version"), F.lit("table"), F.col("page_start"), F.col("section_path"), F.lit(0), F.get("parts", F.lit(0)))
    piece = lambda md, i, row: F.struct(md.alias("md"), i.alias("i"), F.lit(row).alias("is_row"))
    whole = F.transform("parts", lambda md, i: piece(md, i, False))
    groups = F.transform(row_groups(F.col("header"), F.col("body"), F.col("notes"), register), lambda g: piece(g["markdown"], g["index"], True))
    t = bound(t, parent=F.when(F.size("parts") > 0, parent), pieces=F.when(F.size("parts") > 0, F.concat(whole, groups)).otherwise(whole))
    t = t.select(*BASE, "p", "cap", "parent", F.explode("pieces").alias("piece"))
    md, is_row = F.col("piece.md"), F.col("piece.is_row")
    return record(t, F.lit("table"), md, F.col("p"), F.col("piece.i"), table_markdown=md, caption=F.col("cap"), parent=F.when(is_row, F.col("parent")), is_row=is_row)


def figure_chunks(figures: DataFrame, profile: Profile = DEFAULT) -> DataFrame:
    """Chunks of drawings and images (BASE, kind figure or bitmap, caption, labels); without caption and labels there is none."""
    f = figures.filter((F.coalesce("caption", F.lit("")) != "") | (F.coalesce("labels", F.lit("")) != ""))
    none = F.when(F.col("kind") == "bitmap", "[Figure: bitmap image]").otherwise("[Figure: (no caption)]")
    cap = F.nullif(F.col("caption"), F.lit(""))
    head = F.coalesce(F.concat(F.lit("[Figure: "), cap, F.lit("]")), none)
    body = F.concat_ws("\n", head, F.nullif(F.col("labels"), F.lit("")))
    return record(f, F.col("kind"), body, _prefix(profile), F.lit(0), caption=cap)


def definition_chunks(sections: DataFrame, profile: Profile = DEFAULT) -> DataFrame:
    """Chunks of the definitions in texts (BASE, raw_text) of sections that are titled as definition sections. They are never front matter."""
    own = sections.filter(F.lower(X.trim_all(F.col("section_title"))).isin(DEFINITION_TITLES))
    found = own.select("*", F.posexplode(X.definitions(F.col("raw_text"))).alias("i", "d"))
    return record(found, F.lit("definition"), F.concat(F.col("d.term"), F.lit(": "), F.col("d.definition")), _prefix(profile), F.col("i"), term=F.col("d.term"), front=F.lit(False))
