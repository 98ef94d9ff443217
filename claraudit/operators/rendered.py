"""Evaluators that compare page snapshots: rows (page, scenario, key, text, clipped, visible, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROTATE = r"(?i)rotate (your|the) (device|phone|screen)|landscape mode only|portrait mode only|turn your device"


def newly_clipped(elements: DataFrame, scenario: str, most: int = 10) -> DataFrame:
    """Elements cut off in a scenario that the baseline shows whole, the first `most` of each page."""
    base = elements.filter((F.col("scenario") == "baseline") & ~F.col("clipped") & F.col("visible")).select("page", "key")
    now = elements.filter((F.col("scenario") == scenario) & F.col("clipped") & F.col("visible"))
    w = Window.partitionBy("page").orderBy("key")
    return now.join(base, ["page", "key"], "left_semi").withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most).select("page", "key")


def with_default(hits: DataFrame, pages: DataFrame, status: Column | str = "PASSED") -> DataFrame:
    """hits (page, key, status) and one row for each page without any."""
    rest = pages.join(hits, "page", "left_anti").select("page", F.lit(None).cast("long").alias("key"), F.lit(status).alias("status"))
    return hits.select("page", "key", "status").unionByName(rest)


def resize_text(elements: DataFrame, pages: DataFrame) -> DataFrame:
    """1.4.4 at 200 %: clipped text, and horizontal scrolling that the baseline doesn't have. pages: page, scroll_before,
    scroll_after."""
    clipped = newly_clipped(elements, "zoom").withColumn("status", F.lit("FAILED"))
    scroll = pages.filter("scroll_after and not scroll_before").select("page", F.lit(-1).cast("long").alias("key"), F.lit("FAILED").alias("status"))
    return with_default(clipped.unionByName(scroll), pages)


def text_spacing(elements: DataFrame, pages: DataFrame) -> DataFrame:
    """1.4.12: clipped text fails, new scrolling is to be reviewed."""
    clipped = newly_clipped(elements, "spacing").withColumn("status", F.lit("FAILED"))
    scroll = pages.filter("scroll_after and not scroll_before").select("page", F.lit(-1).cast("long").alias("key"), F.lit("NEEDS_REVIEW").alias("status"))
    return with_default(clipped.unionByName(scroll), pages)


def reflow(elements: DataFrame, pages: DataFrame, most: int = 3) -> DataFrame:
    """1.4.10 at 320 px: a page that scrolls fails, or is to be reviewed where only exempt elements overflow; status,
    overflowing elements, the first ones' keys."""
    over = elements.filter((F.col("scenario") == "narrow") & F.col("overflows") & F.col("visible"))
    per = over.groupBy("page").agg(F.count(F.lit(1)).alias("n"), F.bool_and("exempt").alias("all_exempt"), F.array_join(F.slice(F.array_sort(F.collect_list(F.when(~F.col("exempt"), F.col("key")))), 1, most), ",").alias("shown"))
    j = pages.join(per, "page", "left")
    status = F.when(~F.col("scroll_after"), "PASSED").when(F.col("all_exempt"), "NEEDS_REVIEW").otherwise("FAILED")
    return j.select("page", status.alias("status"), F.coalesce("n", F.lit(0)).alias("n"), F.when(status == "FAILED", F.coalesce("shown", F.lit(""))).otherwise("").alias("shown"))


def orientation(elements: DataFrame, pages: DataFrame) -> DataFrame:
    """1.3.4, both orientations of each page: rotation notice, missing content, transform lock, hidden overflow, scrolling
    in landscape only. pages: page, scenario, transform, overflow_x, scrolls."""
    words = (F.length(F.trim("text")) > 20) & F.col("visible") & F.col("tag").isin("p", "span", "h1", "h2", "h3", "li", "td", "article", "main")
    per = elements.groupBy("page", "scenario").agg(F.bool_or(F.col("text").rlike(ROTATE)).alias("rotate"), F.count_if(words).alias("texts"))
    j = pages.join(per, ["page", "scenario"], "left").withColumn("texts", F.coalesce("texts", F.lit(0)))
    w = Window.partitionBy("page")
    portrait = F.bool_or((F.col("scenario") == "portrait") & F.col("scrolls")).over(w)
    codes = F.array_compact(F.array(
        F.when(F.col("rotate"), "rotate_notice"), F.when(F.col("texts") < 3, "missing_content"), F.when(F.lower("transform").rlike(r"matrix\(|rotate\("), "transform_lock"),
        F.when(F.lower("overflow_x").isin("hidden", "clip"), "overflow_hidden"), F.when((F.col("scenario") == "landscape") & F.col("scrolls") & ~portrait, "landscape_scroll")))
    return j.select("page", "scenario", F.array_join(codes, ",").alias("codes"))


def hover_content(rows: DataFrame) -> DataFrame:
    """1.4.13: dismissable, hoverable, persistent, each true, false or untested."""
    three = [F.col(c) for c in ("dismissable", "hoverable", "persistent")]
    false, unknown = [c.eqNullSafe(F.lit(False)) for c in three], [c.isNull() for c in three]
    some_false, some_unknown = false[0] | false[1] | false[2], unknown[0] | unknown[1] | unknown[2]
    return rows.withColumn("status", F.when(~F.col("appeared"), "PASSED").when(some_false & (~some_unknown | F.col("certain")), "FAILED").when(some_false | some_unknown, "NEEDS_REVIEW").otherwise("PASSED"))
