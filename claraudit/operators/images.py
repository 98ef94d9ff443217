"""Images: classes, references, recognised text, and their reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claraudit.functions import text
from claraudit.operators.rules_static import cases, filled, yes

C = F.col


def image_class() -> Column:
    """class/sub-class by ordered context: hidden, button, linked logo, chart, linked icon, link, logo, icon, alternative."""
    has_alt = text.blank_to_null(C("alt")).isNotNull()
    return cases(
        (yes(C("aria_hidden") == "true") | yes(C("role").isin("presentation", "none")), "decorative/presentational"),
        (yes("in_button"), "functional/buttons"),
        (yes("in_link") & yes("looks_logo"), "functional/logos"),
        (yes(C("chart_score") >= 3), "complex/charts"),
        (yes("looks_icon") & (yes("in_link") | yes("has_click")), "functional/icons"),
        (yes("in_link") | yes("has_click"), "functional/images"),
        (yes("looks_logo"), "informative/logos"),
        (yes("looks_icon") & has_alt, "informative/icons"),
        (yes("looks_icon"), "decorative/decorative"),
        (has_alt, "informative/images"),
        (C("alt").isNotNull(), "decorative/decorative"),
        default="decorative/missing_alt",
    )


FILE = r"([\w.-]+\.(?:png|jpe?g|gif|svg|webp|avif))"


def image_reference(reason: Column, src: Column, element_id: Column) -> Column:
    """File name of an image: quoted in the reason, the element's id, the source, or named in the reason."""
    found = [F.regexp_extract(F.coalesce(reason, F.lit("")), "['\"][^'\"]*?" + FILE + "['\"]", 1), F.regexp_extract(F.coalesce(element_id, F.lit("")), f"(?i){FILE}", 1), F.regexp_extract(F.regexp_replace(F.coalesce(src, F.lit("")), r"[?#].*$", ""), r"([^/]+)$", 1), F.regexp_extract(F.coalesce(reason, F.lit("")), f"(?i){FILE}", 1)]
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in found])


def with_ocr(images: DataFrame, ocr: DataFrame) -> DataFrame:
    """Images with the text of the first recognition result of the same file name, whatever its folder and case."""
    name = lambda c: F.lower(F.regexp_extract(F.coalesce(C(c), F.lit("")), r"([^/\\]+)$", 1))
    first = ocr.groupBy(name("path").alias("_name")).agg(F.min_by("words", "pos").alias("ocr_text"))
    return images.withColumn("_name", name("path")).join(first, "_name", "left").drop("_name")


def image_report(images: DataFrame) -> DataFrame:
    """Counts of each class and of all (class null)."""
    return images.rollup("classification").agg(F.count(F.lit(1)).alias("total"), F.count_if(C("status") == "PASSED").alias("passed"), F.count_if(C("status") == "FAILED").alias("failed"), F.count_if(filled("ocr_text")).alias("with_ocr"))


def contrast_report(regions: DataFrame) -> DataFrame:
    """Regions, violations, images, images with one, and the share of images without, in percent."""
    per = regions.groupBy("image").agg(F.count(F.lit(1)).alias("n"), F.count_if(C("ratio") < C("required")).alias("bad"))
    out = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("regions"), F.coalesce(F.sum("bad"), F.lit(0)).alias("violations"), F.count(F.lit(1)).alias("images"), F.count_if(C("bad") > 0).alias("failing"))
    return out.withColumn("pass_rate", F.when(C("images") == 0, F.lit(0.0)).otherwise(F.round((C("images") - C("failing")) * 100.0 / C("images"), 1)))


def background(ancestors: Column) -> Column:
    """The nearest of ancestors' (color, alpha) that isn't transparent, else white."""
    return F.coalesce(F.get(F.filter(ancestors, lambda a: a["alpha"] > 0), 0)["color"], F.lit("rgb(255, 255, 255)"))


def region_contrast(pixels: DataFrame, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """image, dark, light: the luminance percentiles that stand for text and ground of a region's pixels."""
    return pixels.groupBy("image").agg(F.percentile("luminance", low).alias("dark"), F.percentile("luminance", high).alias("light"))


def otsu(pixels: DataFrame, *keys: str, level: str = "level") -> DataFrame:
    """keys, threshold, dark, light: the level that parts an image's pixels (0 to 255) into the two classes whose means lie
    furthest apart for their sizes, the lowest such one, and the means of those up to it and above it. Pixels are counted by
    level, with map-side sums; what meets in a task are an image's levels. null where all pixels are of one level."""
    histogram = pixels.groupBy(*keys, C(level).cast("long").alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    image = Window.partitionBy(*keys)
    upto = image.orderBy("_v")
    rows = histogram.select("*", F.sum("_c").over(upto).alias("_n0"), F.sum(C("_c") * C("_v")).over(upto).alias("_s0"), F.sum("_c").over(image).alias("_n"), F.sum(C("_c") * C("_v")).over(image).alias("_s"))
    d = lambda c: C(c).cast("double")
    apart = d("_n") * d("_s0") - d("_n0") * d("_s")
    between = F.when(C("_n0") < C("_n"), apart * apart / (d("_n0") * (d("_n") - d("_n0"))))
    best = F.max_by(F.struct("_v", "_n0", "_s0", "_n", "_s"), F.struct(F.coalesce(C("_between"), F.lit(-1.0)).alias("b"), (-C("_v")).alias("v")))
    out = rows.withColumn("_between", between).groupBy(*keys).agg(best.alias("x"), F.max("_between").alias("_most"))
    some = lambda v: F.when(C("_most").isNotNull(), v)
    x = lambda c: C(f"x.{c}").cast("double")
    return out.select(*keys, some(C("x._v")).alias("threshold"), some(x("_s0") / x("_n0")).alias("dark"), some((x("_s") - x("_s0")) / (x("_n") - x("_n0"))).alias("light"))


def first_frames(frames: DataFrame) -> DataFrame:
    """page, frames walked, frames skipped for their origin, whether the snapshot is partial."""
    w = frames.groupBy("page").agg(F.count_if("same_origin").alias("walked"), F.count_if(~C("same_origin")).alias("skipped"))
    return w.withColumn("partial", C("skipped") > 0)


def numbered(rows: DataFrame, by: str, order: str) -> DataFrame:
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(by).orderBy(order)))
