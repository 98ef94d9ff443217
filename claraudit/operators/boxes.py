"""Joins of boxes on one page: gaps, offsets, coverage, pairs. Every box of a page counts. Boxes that can meet are found by
(page, level, grid cell): a level's cells are about as large as its boxes, and smaller boxes enter coarser levels' cells,
so that work follows the boxes that are near each other. ids name boxes: a page's are distinct."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claraudit.functions.rects import Box, gap_x, gap_y, intersects, overlap_ratio

TARGET = 24.0
_BOX = ("id", "x", "y", "w", "h")


def _reach(boxes: DataFrame, rx: Column, ry: Column) -> DataFrame:
    """page, box, the extent (x0, y0, x1, y1) of the box widened by rx and ry, and its level: cells of 2**level hold it."""
    c = Box()
    ends = [c.x - rx, c.y - ry, c.right + rx, c.bottom + ry]
    x0, y0, x1, y1 = F.least(ends[0], ends[2]), F.least(ends[1], ends[3]), F.greatest(ends[0], ends[2]), F.greatest(ends[1], ends[3])
    out = boxes.select("page", F.struct(*_BOX).alias("box"), x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))
    size = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.lit(32.0))
    return out.withColumn("level", (F.ceil(F.log2(size) / 2) * 2).cast("int"))


def _celled(reach: DataFrame, level: Column) -> DataFrame:
    """A row for each cell that the extent touches."""
    out = reach.withColumn("at", level).withColumn("_size", F.pow(F.lit(2.0), F.col("at")))
    for c in "xy":
        lo, hi = (F.floor(F.col(f"{c}{i}") / F.col("_size")).cast("long") for i in (0, 1))
        out = out.withColumn(f"c{c}", F.explode(F.sequence(lo, hi)))
    return out


def _meeting(left: DataFrame, right: DataFrame) -> DataFrame:
    """page, a, b (boxes of other ids) whose extents touch, each pair once: in the cell where what they share begins."""
    out = None
    for own, other, names, coarser in ((left, right, "pq", F.col("level") <= F.col("_l")), (right, left, "qp", F.col("level") < F.col("_l"))):
        levels = own.groupBy("page").agg(F.collect_set("level").alias("_levels"))
        many = other.join(levels, "page").withColumn("_l", F.explode("_levels")).filter(coarser)
        x, y = _celled(own, F.col("level")).alias(names[0]), _celled(many, F.col("_l")).alias(names[1])
        same = F.lit(True)
        for c in ("page", "at", "cx", "cy"):
            same = same & (F.col(f"p.{c}") == F.col(f"q.{c}"))
        first = [F.floor(F.greatest(F.col(f"p.{c}0"), F.col(f"q.{c}0")) / F.col("p._size")) == F.col(f"p.c{c}") for c in "xy"]
        touch = [(F.col(f"p.{c}0") <= F.col(f"q.{c}1")) & (F.col(f"q.{c}0") <= F.col(f"p.{c}1")) for c in "xy"]
        met = x.join(y, same & first[0] & first[1] & touch[0] & touch[1] & (F.col("p.box.id") != F.col("q.box.id")))
        met = met.select(F.col("p.page").alias("page"), F.col("p.box").alias("a"), F.col("q.box").alias("b"))
        out = met if out is None else out.unionByName(met)
    return out


def _spread(v: Column) -> Column:
    """31 bits of v, a zero bit behind each."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


def nearest_gap(boxes: DataFrame) -> DataFrame:
    """page, id, gap: the least larger-of-two-axes gap to another box of the page, 0 if there is none."""
    c, a, b = Box(), Box("a."), Box("b.")
    # some other box bounds the gap: the neighbours along a curve through the page's grid; the join then looks that far
    middle = [F.greatest(F.lit(0), F.least(F.lit((1 << 31) - 1), F.floor(m + (1 << 30)))).cast("long") for m in (c.x + c.w / 2, c.y + c.h / 2)]
    curve = Window.partitionBy("page").orderBy(_spread(middle[0]).bitwiseOR(F.shiftleft(_spread(middle[1]), 1)), "id")
    here = boxes.select("page", *_BOX)
    near = here.withColumn("_near", F.array(*[F.lag(F.struct(*_BOX), k).over(curve) for k in (-2, -1, 1, 2)]))
    # a function of the array, so that its code is there once, however often the bound is read
    apart = lambda n: F.when(n["id"] != F.col("id"), F.greatest(F.lit(0.0), *[d for s, e in (("x", "w"), ("y", "h")) for d in (n[s] - F.col(s) - F.col(e), F.col(s) - n[s] - n[e])]))
    near = near.withColumn("_bound", F.when(F.col("page").isNotNull(), F.array_min(F.transform("_near", apart))))
    far = F.col("_bound") * (1 + 1e-9) + 1e-9  # beyond rounding
    met = _meeting(_reach(near.filter("_bound > 0"), far, far), _reach(here, F.lit(0.0), F.lit(0.0)))
    found = met.groupBy("page", F.col("a.id").alias("id")).agg(F.min(F.greatest(gap_x(a, b), gap_y(a, b))).alias("_found"))
    return near.join(found, ["page", "id"], "left").select("page", "id", F.coalesce(F.least("_bound", "_found"), F.lit(0.0)).alias("gap"))


def offset_exception(boxes: DataFrame) -> DataFrame:
    """page, id, gap_x, gap_y (each axis by itself, null if alone), offset_exception: a small box whose extension to the
    target size meets no other box."""
    c, a, b = Box(), Box("a."), Box("b.")
    rows = boxes.select("page", *_BOX)
    for axis, start, end in (("x", c.x, c.right), ("y", c.y, c.bottom)):
        # along one axis, the nearest are the one that reaches furthest of those before and the next one
        order = Window.partitionBy("page").orderBy(axis, "id")
        before = start - F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
        after = F.lead(axis).over(order) - end
        gap = F.when(before.isNotNull() | after.isNotNull(), F.greatest(F.lit(0.0), F.least(before, after)))
        rows = rows.withColumn(f"gap_{axis}", F.when(F.col("page").isNotNull(), gap))
    small = (F.col("w") < TARGET) | (F.col("h") < TARGET)
    extra = lambda box: [F.greatest(F.lit(0.0), (F.lit(TARGET) - s) / 2) for s in (box.w, box.h)]
    rx, ry = extra(a)
    meets = (b.right > a.x - rx) & (b.x < a.right + rx) & (b.bottom > a.y - ry) & (b.y < a.bottom + ry)
    met = _meeting(_reach(boxes.filter(small), *extra(c)), _reach(boxes, F.lit(0.0), F.lit(0.0))).filter(meets)
    rows = rows.join(met.select("page", F.col("a.id").alias("id"), F.lit(True).alias("_meets")).distinct(), ["page", "id"], "left")
    return rows.select("page", "id", "gap_x", "gap_y", (small & F.col("_meets").isNull()).alias("offset_exception"))


def obscuration(focus: DataFrame, overlays: DataFrame, least: float = 0.05) -> DataFrame:
    """page, id, ratio (most covered by one overlay of the page), n_covering (overlays that cover more than `least`)."""
    ratio = overlap_ratio(Box("a."), Box("b."))
    met = _meeting(_reach(focus, F.lit(0.0), F.lit(0.0)), _reach(overlays, F.lit(0.0), F.lit(0.0)))
    met = met.groupBy("page", F.col("a.id").alias("id")).agg(F.max(ratio).alias("_most"), F.count_if(ratio > least).alias("_n"))
    rows = focus.select("page", "id").join(met, ["page", "id"], "left")
    return rows.select("page", "id", F.round(F.coalesce("_most", F.lit(0.0)), 4).alias("ratio"), F.coalesce("_n", F.lit(0)).cast("long").alias("n_covering"))


def focus_not_obscured(steps: DataFrame, pages: DataFrame, fail: float = 0.95, review: float = 0.10) -> DataFrame:
    """2.4.11 (2.4.12 with .10 and .02): a row for each hidden or partly hidden step; a page without one passes once."""
    status = F.when(F.col("ratio") >= fail, "FAILED").when(F.col("ratio") >= review, "NEEDS_REVIEW")
    hits = steps.select("page", "id", status.alias("status")).filter("status is not null")
    rest = pages.join(hits, "page", "left_anti").select("page", F.lit(None).cast("long").alias("id"), F.lit("PASSED").alias("status"))
    return hits.unionByName(rest)


def overlapping_pairs(boxes: DataFrame) -> DataFrame:
    """page, a, b (a < b) of boxes that meet."""
    reach = _reach(boxes, F.lit(0.0), F.lit(0.0))
    both = _meeting(reach, reach).filter((F.col("a.id") < F.col("b.id")) & intersects(Box("a."), Box("b.")))
    return both.select("page", F.col("a.id").alias("a"), F.col("b.id").alias("b"))
