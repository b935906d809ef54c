"""Spatial operators on page blocks (boxes x0, y0, x1, y1; y grows downwards)."""

from __future__ import annotations

import bisect
import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..profile import CAPTION_MARGIN, CLUSTER_PADDING, FIGURE_AREA, FOOTER_MARGIN, HEADER_MARGIN, RULE_GAP, RULE_WIDTH, TABLE_PADDING
from ..schema import DRAWING


def in_margin(y0: Column, y1: Column, height: Column) -> Column:
    return (y1 < HEADER_MARGIN) | (y0 > height - FOOTER_MARGIN)


def outside_tables(texts: DataFrame, tables: DataFrame, page: list[str], padding: float = TABLE_PADDING) -> DataFrame:
    """Text blocks whose centre lies in no table of their page."""
    t = tables.select(*[F.col(c).alias(f"t_{c}") for c in [*page, "x0", "y0", "x1", "y1"]])
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    same = [F.col(c) == F.col(f"t_{c}") for c in page]
    inside = cx.between(F.col("t_x0") - padding, F.col("t_x1") + padding) & cy.between(F.col("t_y0") - padding, F.col("t_y1") + padding)
    on = inside
    for s in same:
        on = s & on
    return texts.join(t, on, "left_anti")


def labels_in_boxes(texts: DataFrame, boxes: DataFrame, page: list[str], box: str, grow: float = 0.0) -> DataFrame:
    """(page, box, labels): texts of blocks whose centre lies in the box, grown up (not above 0) and down, in block order."""
    b = boxes.select(*page, box, F.col("x0").alias("b_x0"), F.greatest(F.col("y0") - grow, F.lit(0.0)).alias("b_y0") if grow else F.col("y0").alias("b_y0"), F.col("x1").alias("b_x1"), (F.col("y1") + grow).alias("b_y1"))
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    hit = texts.join(b, page).filter(cx.between(F.col("b_x0"), F.col("b_x1")) & cy.between(F.col("b_y0"), F.col("b_y1")))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("block_ord", F.trim("text").alias("t")))), lambda x: x["t"])
    return hit.groupBy(*page, box).agg(F.array_join(lines, "\n").alias("labels"), F.count("*").alias("n_labels"))


def gap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Vertical distance of two boxes, -1 where they overlap."""
    return F.when(a1 <= b0, b0 - a1).when(b1 <= a0, a0 - b1).otherwise(-1.0)


def nearest_caption(boxes: DataFrame, texts: DataFrame, page: list[str], box: str, margin: float = CAPTION_MARGIN) -> DataFrame:
    """(page, box, caption): of the captions within the margin above or below, the nearest; ties to the first block. Only captions are joined."""
    t = texts.withColumn("caption", X.figure_caption(F.col("text"))).filter("caption <> ''").select(*page, "block_ord", "caption", F.col("y0").alias("t_y0"), F.col("y1").alias("t_y1"))
    near = boxes.join(t, page).withColumn("dist", gap(F.col("y0"), F.col("y1"), F.col("t_y0"), F.col("t_y1"))).filter(F.col("dist").between(0, margin))
    return near.groupBy(*page, box).agg(F.min_by("caption", F.struct("dist", "block_ord")).alias("caption"), F.min("dist").alias("dist"))


def heading_rules(edges: Column, width: Column) -> Column:
    """Whether two wide horizontal lines that follow one another leave a heading's gap. edges: array of x0, x1, top, bottom; null is none."""
    wide = F.filter(F.coalesce(edges, F.array()), lambda e: F.abs(e["x1"] - e["x0"]) > width * RULE_WIDTH)
    lines = F.array_sort(F.transform(wide, lambda e, i: F.struct(e["top"].alias("top"), i.alias("i"), e["bottom"].alias("bottom"))))
    gaps = X.let(lines, lambda sorted_: F.transform(sorted_, lambda e, i: F.get(sorted_, i + 1)["top"] - e["bottom"]))
    return F.exists(gaps, lambda g: F.coalesce(g.between(*RULE_GAP), F.lit(False)))


def cluster_boxes(boxes: Column, padding: float = CLUSTER_PADDING, least_area: float = FIGURE_AREA) -> Column:
    """Array of schema.DRAWING: boxes (array of x0, y0, x1, y1) merged until no two merged boxes come within the padding; small ones go.

    Boxes without width or height, or with a null, take no part. The closure of merging boxes that grow is not a set of connected
    components of the first boxes, so a page's boxes are merged together, in Arrow, where the page's row is: no shuffle.
    """
    kind = T.ArrayType(DRAWING)

    @F.arrow_udf(kind)
    def run(column):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        out = []
        for page in column.to_pylist():
            found = [tuple(b[c] for c in ("x0", "y0", "x1", "y1")) for b in page or [] if b is not None]
            merged = merge_boxes([b for b in found if None not in b and b[2] > b[0] and b[3] > b[1]], padding)
            sized = [(m, (m[2] - m[0]) * (m[3] - m[1])) for m in merged]
            out.append([dict(zip(DRAWING.fieldNames(), (*m[:4], area, m[4]), strict=True)) for m, area in sized if area >= least_area])
        return pa.array(out, to_arrow_type(kind))

    return run(boxes)


def merge_boxes(boxes: list[tuple[float, float, float, float]], padding: float = CLUSTER_PADDING) -> list[tuple]:
    """Merged boxes with their number of elements, in order of place: the closure of merging boxes that come near, again as they grow.

    Swept along x until a sweep merges nothing. The boxes that are open at a place all meet there in x, so those that are not merged
    lie apart in y: they are kept in that order, and a new box meets neighbours in it only.
    """
    now = sorted((*b, 1) for b in boxes)
    while True:
        before = len(now)
        now = sorted(_sweep(now, padding))
        if len(now) == before:
            return now


def _sweep(boxes: list[tuple], padding: float) -> list[tuple]:
    """One sweep over boxes (x0, y0, x1, y1, elements) in order of x0."""
    tops: list[float] = []  # y0 of the open boxes, which rise, and the boxes
    open_: list[tuple] = []
    ends: list[tuple[float, float, tuple]] = []  # by x1
    done: list[tuple] = []

    def place(box: tuple) -> int:
        """Where an open box is, or -1 when it was merged."""
        i = bisect.bisect_left(tops, box[1])
        while i < len(tops) and tops[i] == box[1]:
            if open_[i] is box:
                return i
            i += 1
        return -1

    for new in boxes:
        while ends and ends[0][0] <= new[0] - padding:
            i = place(box := heapq.heappop(ends)[2])
            if i >= 0:
                done.append(box)
                del tops[i], open_[i]
        grown = True
        while grown:
            # open boxes lie apart in y, so the ends of those from here down rise too
            low = bisect.bisect_left(tops, new[3] + padding)
            first = low
            while first and open_[first - 1][3] > new[1] - padding:
                first -= 1
            near = open_[first:low]
            grown = bool(near)
            if near:
                new = (min(new[0], *(b[0] for b in near)), min(new[1], near[0][1]), max(new[2], *(b[2] for b in near)), max(new[3], near[-1][3]), new[4] + sum(b[4] for b in near))
                del tops[first:low], open_[first:low]
        i = bisect.bisect_left(tops, new[1])
        tops.insert(i, new[1])
        open_.insert(i, new)
        heapq.heappush(ends, (new[2], new[1], new))
    return done + open_


def classify(texts: DataFrame, tables: DataFrame, drawings: DataFrame, images: DataFrame, page: list[str], title: Column) -> DataFrame:
    """All blocks of a page by kind, in order of their top edge; ties: tables, drawings, images, then texts, each in its own order."""
    shape = lambda df, kind, rank: df.select(*page, "y0", F.lit(rank).alias("build"), F.col("block_ord").alias("own_ord"), F.lit(kind).alias("kind"), (F.col("text") if "text" in df.columns else F.lit(None).cast("string")).alias("text"))
    plain = outside_tables(texts, tables, page).withColumn("kind", X.block_kind(F.col("text"), title))
    plain = plain.select(*page, "y0", F.lit(3).alias("build"), F.col("block_ord").alias("own_ord"), "kind", "text")
    every = shape(tables, "table", 0).unionByName(shape(drawings, "figure", 1)).unionByName(shape(images, "bitmap", 2)).unionByName(plain)
    return every.withColumn("block_ord", F.row_number().over(Window.partitionBy(*page).orderBy("y0", "build", "own_ord")))
