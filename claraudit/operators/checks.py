"""Page-level checks on raw markup. Each gives a status a page (pass, incomplete, fail) as Column expressions over the html
and tags of page_links.prepared()."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claraudit.functions import text
from claraudit.operators.page_links import VALUE, prepared, value_of, values

# Link texts that say nothing about the target.
GENERIC_LINKS = r"click\s+here|here|read\s+more|more|learn\s+more|more\s+info(?:rmation)?|details|continue|go|link|this|see\s+more|view\s+more|find\s+out\s+more|click|tap|press\s+here|start|begin|open|show|hide|toggle"


def _has(pattern: str, column: str = "tags") -> Column:
    return F.col(column).rlike(pattern)


def is_generic(link_text: Column) -> Column:
    return F.lower(link_text).rlike(rf"^({GENERIC_LINKS})\.?$")


def link_purpose(links: DataFrame, most: int = 2000) -> DataFrame:
    """Links with an accessible text and whether that is generic (2.4.9), the first `most` of each page."""
    order = Window.partitionBy("page_id").orderBy("pos")
    rows = links.withColumn("_r", F.row_number().over(order)).filter((F.col("_r") <= most) & (F.col("text") != ""))
    return rows.withColumn("generic", is_generic(F.col("text"))).drop("_r")


_NAMED = r"""(?i)\s(?:class|id|aria-label|itemtype)\s*=\s*(?:"[^"]*|'[^']*|[^\s"'>]*)"""


def location_status() -> Column:
    """2.4.8: a breadcrumb by name or type, the current page or step, a selected entry, a site map, or structured data of a
    breadcrumb show where one is."""
    site_map = _has(r"(?i)\s(?:href|aria-label)\s*=\s*[^>]*site[- ]?map") | _has(r"(?is)<a\s[^>]*>[^<]*site\s*-?map", "html")
    signs = [_has(_NAMED + r"(?:breadcrumb|pan-kuzu|panku-zu)"), _has(r"""(?i)\saria-current\s*=\s*["']?(?:page|step)"""), _has(r"""(?i)\saria-selected\s*=\s*["']?true"""), site_map, _has(r"(?is)<script[^>]*ld\+json[^>]*>[^<]*\"BreadcrumbList\"", "html")]
    return F.when(F.coalesce(signs[0] | signs[1] | signs[2] | signs[3] | signs[4], F.lit(False)), "pass").otherwise("incomplete")


def location(pages: DataFrame) -> DataFrame:
    return prepared(pages).withColumn("status", location_status())


def ways() -> Column:
    """2.4.5: how many there are of search, site map, navigation, breadcrumb and table of contents."""
    kinds = [
        r"""(?i)type\s*=\s*["']?search|role\s*=\s*["']?search|<form[^>]*(action|aria-label)\s*=\s*["']?[^"'>]*search""",
        r"(?i)\s(?:href|aria-label|class|id)\s*=\s*[^>]*site-?map",
        r"""(?i)<nav[\s>]|role\s*=\s*["']?navigation""",
        r"""(?i)(class|id|aria-label|itemtype)\s*=\s*["']?[^"'>]*breadcrumb""",
        r"""(?i)(class|id|aria-label)\s*=\s*["']?[^"'>]*(\btoc\b|table of contents)""",
    ]
    return sum((_has(w).cast("long") for w in kinds), F.lit(0).cast("long"))


def multiple_ways_status() -> Column:
    return F.when(ways() >= 2, "pass").otherwise("incomplete")


def multiple_ways(pages: DataFrame) -> DataFrame:
    return prepared(pages).withColumn("ways", ways()).withColumn("status", F.when(F.col("ways") >= 2, "pass").otherwise("incomplete"))


def help_kinds() -> Column:
    """3.2.6: which of help link, widget, phone number and mail address are there."""
    kinds = {
        "link": r"(?i)<a\s[^>]*>[^<]*(help|support|contact|faq)[^<]*</a",
        "widget": r"""(?i)(class|id)\s*=\s*["']?[^"'>]*(chat|helpdesk|intercom|zendesk)""",
        "phone": r"""(?i)href\s*=\s*["']?tel:""",
        "mail": r"""(?i)href\s*=\s*["']?mailto:""",
    }
    return F.array_compact(F.array(*[F.when(_has(p, "html" if k == "link" else "tags"), k) for k, p in kinds.items()]))


def consistent_help_status() -> Column:
    return F.when(F.size(help_kinds()) > 0, "pass").otherwise("incomplete")


def consistent_help(pages: DataFrame) -> DataFrame:
    return prepared(pages).withColumn("_found", help_kinds()).withColumn("kinds", F.array_join("_found", ",")).withColumn("status", F.when(F.size("_found") > 0, "pass").otherwise("incomplete")).drop("_found")


def page_lang() -> Column:
    return value_of(F.regexp_extract("tags", r"(?is)<html\b[^>]*", 0), r"(?i)\slang" + VALUE)


def pronunciation_status(density: float = 0.05) -> Column:
    """3.1.6: pages in Chinese, Japanese or Korean, by language or density, need ruby where they have ideographs."""
    body = F.regexp_replace("html", "<[^>]*>", " ")
    applies = F.lower(page_lang()).rlike("^(ja|zh|ko)(-|$)") | (text.cjk_ratio(body) >= density)
    return F.when(~applies, "pass").when(~body.rlike("[一-鿿]"), "pass").when(_has(r"(?i)<ruby[\s>]"), "incomplete").otherwise("fail")


def pronunciation(pages: DataFrame, density: float = 0.05) -> DataFrame:
    return prepared(pages).select("page_id", page_lang().alias("lang"), pronunciation_status(density).alias("status"))


def _ids() -> Column:
    return F.filter(values(r"(?i)\sid" + VALUE), lambda x: x != "")


def _refs() -> Column:
    lists = values(r"(?i)\s(?:aria-labelledby|aria-describedby|aria-controls|aria-owns|for)" + VALUE)
    return F.filter(F.flatten(F.transform(lists, lambda r: F.split(r, r"\s+"))), lambda r: r != "")


def parsing_status() -> Column:
    """4.1.1: ids that occur again, or references to ids that aren't there."""
    ids = _ids()
    return F.when((F.size(ids) > F.size(F.array_distinct(ids))) | (F.size(F.array_except(_refs(), ids)) > 0), "fail").otherwise("pass")


def html_parsing(pages: DataFrame) -> DataFrame:
    """4.1.1 with numbers of ids that occur again and of broken references. One scan, no shuffle: ids stay in their row."""
    rows = prepared(pages).select("page_id", _ids().alias("ids"), _refs().alias("refs"))
    rows = rows.withColumn("missing", F.array_except("refs", "ids"))
    out = rows.select("page_id", (F.size("ids") - F.size(F.array_distinct("ids"))).cast("long").alias("duplicate_ids"), F.size(F.filter("refs", lambda r: F.array_contains("missing", r))).cast("long").alias("broken_refs"))
    return out.withColumn("status", F.when(F.col("duplicate_ids") + F.col("broken_refs") > 0, "fail").otherwise("pass"))
