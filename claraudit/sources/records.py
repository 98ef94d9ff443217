"""Records of elements with boxes and styles, and the flat views and summaries that reports show of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claraudit.functions import text
from claraudit.operators import reports
from claraudit.operators.rules_static import yes

#: Characters from which an element counts as a block of text, and a height that doesn't grow with it.
TEXT_LEAST, FIXED_HEIGHT = 20, r"^\d+(\.\d+)?px$"


def targets(boxes: DataFrame, least: float = 24.0) -> DataFrame:
    """Interactive boxes (w, h, and where known display, in_paragraph, styled): their size with whether it is small, and the
    inline and user-agent exceptions."""
    has = lambda c, d: F.col(c) if c in boxes.columns else F.lit(d)
    inline = yes(has("in_paragraph", None).cast("boolean")) | F.coalesce(has("display", None).cast("string") == "inline", F.lit(False))
    return boxes.withColumn("small", (F.col("w") < least) | (F.col("h") < least)).withColumn("inline", inline).withColumn("ua_controlled", ~F.coalesce(has("styled", True).cast("boolean"), F.lit(True)))


def text_spacing(blocks: DataFrame, least: int = TEXT_LEAST) -> DataFrame:
    """Blocks (text, height as styled) of enough text with whether their height is fixed."""
    return blocks.filter(F.length("text") >= least).withColumn("fixed", F.coalesce(F.col("height").rlike(FIXED_HEIGHT), F.lit(False)))


def flat_element(html_snippet: Column, html: Column, selectors: list[Column], target: Column) -> list[Column]:
    """element_html and element_selector of a finding: its own snippet before the element's, the first selector, the first target."""
    return [F.coalesce(text.blank_to_null(html_snippet), html, F.lit("")).alias("element_html"), F.coalesce(*selectors, F.get(F.split(target, ","), 0)).alias("element_selector")]


def form_summary(fields: DataFrame) -> DataFrame:
    """Fields, those without a label, required ones, and the share with a label in percent."""
    need = yes("required") | (F.lower(F.coalesce("aria_required", F.lit(""))) == "true")
    n = F.count(F.lit(1))
    return fields.agg(n.alias("total"), F.count_if(~F.col("has_any_label")).alias("missing_label"), F.count_if(need).alias("required"), reports.pass_rate(F.count_if("has_any_label"), n).alias("labelled_rate"))


def sensory_summary(findings: DataFrame) -> DataFrame:
    """Failures and pages with one, by sensory category."""
    each = findings.filter("status = 'FAILED'").select("page", F.explode(F.split("categories", ",")).alias("category"))
    return each.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("page").alias("pages"))
