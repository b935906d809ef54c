"""The records: chunks, sections, page blocks, hits."""

from __future__ import annotations

from pyspark.sql import types as T

S, I, D, B = T.StringType(), T.IntegerType(), T.DoubleType(), T.BooleanType()  # noqa: E741


def struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


CONTENT_TYPES = ["text", "table", "figure", "bitmap", "definition", "register"]

CHUNK = struct(
    chunk_id=S, source=S, version=S, page_start=I, page_end=I, section_path=T.ArrayType(S), section_title=S, heading_level=I,
    content_type=S, is_front_matter=B, chunk_index=I, text=S, raw_text=S, table_markdown=S, figure_caption=S, term=S,
    parent_chunk_id=S, is_row_chunk=B,
)

TEXT_BLOCK = struct(x0=D, y0=D, x1=D, y1=D, text=S, font_size=D, font_flags=I, block_no=I)
DRAWING = struct(x0=D, y0=D, x1=D, y1=D, area=D, element_count=I)
IMAGE = struct(x0=D, y0=D, x1=D, y1=D, xref=I, width=I, height=I)
TABLE = struct(x0=D, y0=D, x1=D, y1=D, rows=T.ArrayType(T.ArrayType(S)))
PAGE = struct(source=S, version=S, page_num=I, width=D, height=D, text_blocks=T.ArrayType(TEXT_BLOCK), drawing_clusters=T.ArrayType(DRAWING), image_blocks=T.ArrayType(IMAGE), table_blocks=T.ArrayType(TABLE))
BOX = struct(x0=D, y0=D, x1=D, y1=D)
SPAN = struct(text=S, size=D, flags=I)
#: what a decoder finds on a page before anything is cleaned, joined or chosen (see sources.pages)
RAW_PAGE = struct(
    source=S, version=S, page_num=I, width=D, height=D, blocks=T.ArrayType(struct(type=I, x0=D, y0=D, x1=D, y1=D, block_no=I, spans=T.ArrayType(SPAN))),
    drawings=T.ArrayType(BOX), images=T.ArrayType(struct(xref=I, width=I, height=I, rects=T.ArrayType(BOX))),
    edges=T.ArrayType(struct(orientation=S, x0=D, x1=D, top=D, bottom=D)), ruled_tables=T.ArrayType(TABLE), aligned_tables=T.ArrayType(TABLE),
)
TOC = struct(source=S, toc_ord=I, level=I, title=S, page_start=I)
QUESTION = struct(id=S, type=S, version=S, question=S, reference=S, notes=S)
RESPONSE = struct(id=S, question=S, response=S, contexts=T.ArrayType(S), reference=S)
