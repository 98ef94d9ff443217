"""Colour functions: parsing, relative luminance and contrast ratio, all as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def parse_rgb(color: Column) -> Column:
    """array(r, g, b) of `#rgb`, `#rrggbb` or the first three numbers of a functional notation; black otherwise."""
    c = F.lower(F.trim(color))
    hex6 = F.when(F.length(c) == 4, F.concat(*[F.substring(c, i, 1) for i in (2, 2, 3, 3, 4, 4)])).otherwise(F.substring(c, 2, 6))
    from_hex = F.array(*[F.conv(F.substring(hex6, i, 2), 16, 10).cast("int") for i in (1, 3, 5)])
    numbers = F.transform(F.slice(F.regexp_extract_all(c, F.lit(r"(\d+)"), F.lit(1)), 1, 3), lambda x: x.cast("int"))
    black = F.array(F.lit(0), F.lit(0), F.lit(0))
    return F.when(c.rlike(r"^#([0-9a-f]{3}|[0-9a-f]{6})$"), from_hex).when(c.startswith("rgb") & (F.size(numbers) == 3), numbers).otherwise(black)


def luminance(rgb: Column, breakpoint: float = 0.04045) -> Column:
    """Relative luminance of array(r, g, b). The breakpoint is .04045 in the standard's errata and .03928 in its old text."""

    def linear(v: Column) -> Column:
        s = v / F.lit(255.0)
        return F.when(s <= breakpoint, s / 12.92).otherwise(F.pow((s + 0.055) / 1.055, F.lit(2.4)))

    return let(F.transform(rgb, linear), lambda c: F.element_at(c, 1) * 0.2126 + F.element_at(c, 2) * 0.7152 + F.element_at(c, 3) * 0.0722)


def contrast(a: Column, b: Column, breakpoint: float = 0.04045) -> Column:
    """Contrast ratio of two array(r, g, b), rounded to two places."""
    both = F.struct(luminance(a, breakpoint).alias("x"), luminance(b, breakpoint).alias("y"))
    return let(both, lambda p: F.round((F.greatest(p["x"], p["y"]) + 0.05) / (F.least(p["x"], p["y"]) + 0.05), 2))


def large_text(size_px: Column, weight: Column, bold_px: float = 18.66) -> Column:
    """24 px, or bold and bold_px (18.5 where sizes come from OCR)."""
    bold = F.coalesce(weight, F.lit("400")).isin("bold", "bolder", "700", "800", "900")
    return F.coalesce((size_px >= 24) | (bold & (size_px >= bold_px)), F.lit(False))


def compliance(ratio: Column, large: Column) -> Column:
    """struct(aa, aaa, aa_threshold, aaa_threshold) for a ratio."""
    aa, aaa = F.when(large, F.lit(3.0)).otherwise(F.lit(4.5)), F.when(large, F.lit(4.5)).otherwise(F.lit(7.0))
    return F.struct((ratio >= aa).alias("aa"), (ratio >= aaa).alias("aaa"), aa.alias("aa_threshold"), aaa.alias("aaa_threshold"))
