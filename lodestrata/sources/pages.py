"""From what a decoder finds on pages to page models: array expressions on one row per page, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.formulas import round_tenth
from ..functions.text import clean_text, let
from ..operators import layout, tables
from ..profile import DEFAULT, Profile
from ..schema import IMAGE, PAGE, TABLE


def _list(c: Column) -> Column:
    """The array without its null elements; null is empty."""
    return F.filter(F.coalesce(c, F.array()), lambda x: x.isNotNull())


def merge_spans(spans: Column, profile: Profile = DEFAULT) -> Column:
    """One text of spans (text, size, flags): cleaned texts joined by blanks, their mean size to one decimal, the last one's flags.

    Spans without text after cleaning do not count; null sizes count as 0; without any span the text is empty, the size and the flags 0.
    """
    clean = F.transform(_list(spans), lambda s: F.struct(clean_text(F.coalesce(s["text"], F.lit("")), profile).alias("text"), s["size"].alias("size"), s["flags"].alias("flags")))

    def joined(kept: Column) -> Column:
        total = F.aggregate(kept, F.lit(0.0), lambda t, s: t + F.coalesce(s["size"], F.lit(0.0)))
        return F.struct(
            F.array_join(F.transform(kept, lambda s: s["text"]), " ").alias("text"),
            F.when(F.size(kept) > 0, let(total / F.size(kept), round_tenth)).otherwise(0.0).alias("font_size"),
            F.coalesce(F.try_element_at(kept, F.lit(-1))["flags"], F.lit(0)).alias("font_flags"),
        )

    return let(F.filter(clean, lambda s: s["text"] != ""), joined)


def text_blocks(blocks: Column, height: Column, profile: Profile = DEFAULT) -> Column:
    """Blocks of text (type 0) outside the margins, their spans merged; those without text go."""
    body = F.filter(_list(blocks), lambda b: (b["type"] == 0) & ~F.coalesce(layout.in_margin(b["y0"], b["y1"], height), F.lit(False)))
    merged = F.transform(body, lambda b: F.struct(b.alias("b"), merge_spans(b["spans"], profile).alias("m")))
    full = F.filter(merged, lambda x: x["m"]["text"] != "")
    box = lambda b: [b[c].alias(c) for c in ("x0", "y0", "x1", "y1")]
    return F.transform(full, lambda x: F.struct(*box(x["b"]), *[x["m"][c].alias(c) for c in ("text", "font_size", "font_flags")], F.coalesce(x["b"]["block_no"], F.lit(0)).alias("block_no")))


def image_blocks(images: Column) -> Column:
    """Each image at the first place that it has; images without a place go."""
    placed = F.transform(F.filter(_list(images), lambda i: F.size(_list(i["rects"])) > 0), lambda i: F.struct(i.alias("i"), F.get(_list(i["rects"]), F.lit(0)).alias("r")))
    return F.transform(placed, lambda x: F.struct(*[x["r"][c].alias(c) for c in ("x0", "y0", "x1", "y1")], *[x["i"][c].alias(c) for c in ("xref", "width", "height")]).cast(IMAGE))


def table_blocks(ruled: Column, aligned: Column, edges: Column, width: Column, profile: Profile = DEFAULT) -> Column:
    """Tables by ruled lines; without any, those by aligned text, unless a heading's rules were taken for a table's. Plausible ones, cleaned."""
    lines = F.filter(_list(edges), lambda e: e["orientation"] == "h")
    found = F.when(F.size(_list(ruled)) > 0, _list(ruled)).when(~layout.heading_rules(lines, width), _list(aligned)).otherwise(F.array())
    good = F.filter(found, lambda t: F.coalesce(tables.is_plausible(t["rows"]), F.lit(False)))
    clean = F.transform(good, lambda t: F.struct(*[t[c].alias(c) for c in ("x0", "y0", "x1", "y1")], tables.drop_noise(t["rows"], profile).alias("rows")).cast(TABLE))
    return F.filter(clean, lambda t: F.size(t["rows"]) > 0)


def page_models(raw: DataFrame, profile: Profile = DEFAULT) -> DataFrame:
    """schema.PAGE from schema.RAW_PAGE. A null list is an empty one; further columns are left out; equal pages are each kept."""
    height, width = F.col("height"), F.col("width")
    made = {
        "text_blocks": text_blocks(F.col("blocks"), height, profile),
        "drawing_clusters": layout.cluster_boxes(F.col("drawings")),
        "image_blocks": image_blocks(F.col("images")),
        "table_blocks": table_blocks(F.col("ruled_tables"), F.col("aligned_tables"), F.col("edges"), width, profile),
    }
    return raw.select(*[made.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in PAGE.fields])
