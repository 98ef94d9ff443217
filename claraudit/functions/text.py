"""Text functions as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kana, CJK ideographs (with extension A and compatibility forms) and Hangul syllables.
CJK = r"[぀-ヿ㐀-䶿一-鿿豈-﫿가-힯]"


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def first_filled(*cols: Column) -> Column:
    """The first that is neither null nor blank."""
    return F.coalesce(*[blank_to_null(c) for c in cols])


def norm_alt(c: Column) -> Column:
    """Lower case, everything but letters, digits and underscores to one space."""
    return collapse(F.regexp_replace(F.lower(c), r"(?U)[^\w\s]", " "))


def word_contains(text: Column, part: Column) -> Column:
    """part stands in text at word boundaries on both sides."""
    return F.rlike(text, F.concat(F.lit(r"(?U)\b\Q"), part, F.lit(r"\E\b")))


def cjk_ratio(c: Column) -> Column:
    """The share of CJK characters, 0 for an empty text."""
    n = F.length(c)
    return F.when(F.coalesce(n, F.lit(0)) == 0, F.lit(0.0)).otherwise((n - F.length(F.regexp_replace(c, CJK, ""))) / n)


def tokens(c: Column) -> Column:
    """Distinct lower-case words of letters, digits, underscores and hyphens."""
    words = F.split(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}\s_-]+", " "), r"\s+")
    return F.array_distinct(F.filter(words, lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two token arrays; two empty ones are equal."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def keyword_pattern(terms: Sequence[str]) -> str | None:
    """An alternation of escaped terms, the longest first; None without terms."""
    terms = sorted({t for t in terms if t}, key=lambda t: (-len(t), t))
    return "|".join(re.escape(t) for t in terms) if terms else None


def html_signature(c: Column) -> Column:
    """16 hex digits of the collapsed lower-case markup's first 400 characters; empty for none."""
    flat = F.lower(collapse(F.coalesce(c, F.lit(""))))
    return F.when(flat == "", F.lit("")).otherwise(F.substring(F.sha1(F.substring(flat, 1, 400).cast("binary")), 1, 16))


def target_signature(targets: Column) -> Column:
    """Normalised distinct target strings, joined by two pipes; empty for none."""
    flat = F.transform(F.coalesce(targets, F.array().cast("array<string>")), lambda x: F.lower(collapse(x)))
    return F.array_join(F.array_distinct(F.filter(flat, lambda x: x.isNotNull() & (x != ""))), "||")


def truncate_message(c: Column, most: int = 320) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 3), F.lit("..."))).otherwise(c)


def clean_reason(c: Column) -> Column:
    """Without the scanner's leading 'Fix any/all of the following:' lines."""
    return F.trim(F.regexp_replace(c, r"(?i)^\s*fix (any|all) of the following:\s*", ""))


def sanitize_lang(c: Column) -> Column:
    s = F.substring(F.regexp_replace(F.coalesce(c, F.lit("")), "[^A-Za-z-]", ""), 1, 10)
    return F.when(s == "", F.lit("en")).otherwise(s)


def render_template(template: Column, values: dict[str, Column]) -> Column:
    """{name} replaced by its value, for each name."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return template
