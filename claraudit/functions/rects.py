"""Geometry of axis-parallel boxes given as x, y, w, h columns with a common prefix or suffix."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box:
    """The box of columns x, y, w, h behind a prefix such as 'a.'."""

    def __init__(self, prefix: str = ""):
        self.x, self.y, self.w, self.h = (F.col(prefix + c) for c in ("x", "y", "w", "h"))
        self.right, self.bottom = self.x + self.w, self.y + self.h
        self.area = self.w * self.h


def intersection_area(a: Box, b: Box) -> Column:
    zero = F.lit(0.0)
    return F.greatest(zero, F.least(a.right, b.right) - F.greatest(a.x, b.x)) * F.greatest(zero, F.least(a.bottom, b.bottom) - F.greatest(a.y, b.y))


def overlap_ratio(target: Box, other: Box) -> Column:
    """The share of target that other covers, 0 for an empty target."""
    return F.when(target.area == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), intersection_area(target, other) / target.area))


def intersects(a: Box, b: Box) -> Column:
    return (a.x < b.right) & (a.right > b.x) & (a.y < b.bottom) & (a.bottom > b.y)


def gap_x(a: Box, b: Box) -> Column:
    return F.greatest(F.lit(0.0), b.x - a.right, a.x - b.right)


def gap_y(a: Box, b: Box) -> Column:
    return F.greatest(F.lit(0.0), b.y - a.bottom, a.y - b.bottom)


def offscreen(a: Box, width: float, height: float) -> Column:
    return (a.right <= 0) | (a.bottom <= 0) | (a.x >= width) | (a.y >= height)


def hidden(visible: Column, opacity: Column, display: Column, visibility: Column) -> Column:
    return F.coalesce(~visible | (opacity == 0) | (display == "none") | visibility.isin("hidden", "collapse"), F.lit(False))


def horizontal_scroll(scroll_width: Column, client_width: Column, slack: float = 5.0) -> Column:
    return scroll_width > client_width + slack


def overflow_clipped(scroll: Column, client: Column, overflow: Column, slack: float = 4.0) -> Column:
    """Content of one axis is cut off: hidden or clipped overflow and more content than room."""
    return F.coalesce(overflow.isin("hidden", "clip"), F.lit(False)) & (scroll > client + slack)
