"""Links of raw pages: one row a link, in page order.

Markup is read by regular expressions inside the scan's stage: comments, scripts and styles go first (structured data stays),
then start tags and links are found in one pass each, values in any case and quoting are taken out of the short matches. A
link's text ends at its end tag or, where that is missing, at the next link. Tests hold the links against those of the
parser in sources.html.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claraudit.functions import text, urls

#: The three ways to write a value: of their groups the one that matched is filled.
VALUE = r"""\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
_REST = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
ASIDE = r"(?is)<!--.*?(?:-->|\z)|<(script|style)\b(?![^>]*ld\+json)[^>]*>.*?(?:</\1\s*>|\z)"
TAG = r"<[a-zA-Z]" + _REST
LINK = r"(?is)<a(?=\s)" + _REST + r".*?(?=</?a[\s>]|\z)"


def prepared(pages: DataFrame) -> DataFrame:
    """Pages with html as shown markup (no comments, scripts, styles) and tags, the start tags alone: once for all checks."""
    shown = pages.withColumn("html", F.regexp_replace("html", ASIDE, ""))
    return shown.withColumn("tags", F.array_join(F.regexp_extract_all("html", F.lit(TAG), F.lit(0)), ""))


def value_of(x: Column, pattern: str) -> Column:
    """The value that `pattern`, which ends in VALUE, finds first in x, empty if none."""
    return F.concat(*[F.coalesce(F.regexp_extract(x, pattern, i), F.lit("")) for i in (1, 2, 3)])


def values(pattern: str, column: str = "tags") -> Column:
    """What `pattern`, which ends in VALUE, finds, in page order."""
    return F.transform(F.regexp_extract_all(column, F.lit(pattern), F.lit(0)), lambda x: value_of(x, pattern))


def link_array() -> Column:
    """array<struct<href, text>> of every a[href] of prepared pages; markup inside a link's text is dropped."""
    tag = lambda x: F.regexp_extract(x, "(?is)^<a" + _REST, 0)
    found = F.filter(F.regexp_extract_all("html", F.lit(LINK), F.lit(0)), lambda x: tag(x).rlike(r"(?i)\shref[\s=>/]"))
    words = lambda x: text.collapse(F.regexp_replace(F.regexp_replace(x, "(?is)^<a" + _REST, ""), "<[^>]*>", ""))
    return F.transform(found, lambda x: F.struct(value_of(tag(x), r"(?is)\shref" + VALUE).alias("href"), words(x).alias("text")))


def links(pages: DataFrame) -> DataFrame:
    """page_id, url, pos (from 1), href, text of every a[href]."""
    rows = prepared(pages).select("page_id", "url", F.posexplode(link_array()).alias("i", "x"))
    return rows.select("page_id", "url", (F.col("i") + 1).cast("long").alias("pos"), F.col("x.href").alias("href"), F.col("x.text").alias("text"))


def absolute_links(pages: DataFrame) -> DataFrame:
    return links(pages).withColumn("target", urls.absolute(F.col("url"), F.col("href")))


def first_seen(rows: DataFrame, key: str) -> DataFrame:
    """Each page's distinct values of key with the place of the first."""
    return rows.groupBy("page_id", key).agg(F.min("pos").alias("pos"))


def cap(rows: DataFrame, most: int, by: str = "page_id") -> DataFrame:
    """The first `most` rows of each page: a cap is a page's, never the table's."""
    order = Window.partitionBy(by).orderBy("pos")
    return rows.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= most).drop("_r")


def page_summary(pages: DataFrame) -> DataFrame:
    """Counts of record kinds, one row a page, without a shuffle."""

    def n(pattern: str):
        return F.size(F.regexp_extract_all("tags", F.lit(pattern), F.lit(0))).cast("long")

    rows = prepared(pages)
    return rows.select("page_id", F.size(link_array()).cast("long").alias("links_found"), n(r"(?i)<h1[\s>]").alias("headings"), n(r"(?i)<p[\s>]").alias("paragraphs"), n(r"(?i)<li[\s>]").alias("items"))
