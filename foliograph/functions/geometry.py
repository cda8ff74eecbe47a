"""Geometry over boxes as Columns. A box is left, top, right and bottom in points, origin at the top left."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

BOX = "struct<x0:double,top:double,x1:double,bottom:double>"


class Box(NamedTuple):
    x0: Column
    top: Column
    x1: Column
    bottom: Column

    @classmethod
    def of(cls, column: str | Column) -> Box:
        """From a struct column with the four fields."""
        c = F.col(column) if isinstance(column, str) else column
        return cls(c["x0"], c["top"], c["x1"], c["bottom"])

    @classmethod
    def flat(cls, prefix: str = "") -> Box:
        """From four columns whose names share a prefix."""
        return cls(*(F.col(prefix + n) for n in cls._fields))

    @property
    def width(self) -> Column:
        return self.x1 - self.x0

    @property
    def height(self) -> Column:
        return self.bottom - self.top

    @property
    def center_x(self) -> Column:
        return (self.x0 + self.x1) / 2

    @property
    def center_y(self) -> Column:
        return (self.top + self.bottom) / 2

    @property
    def area(self) -> Column:
        return F.greatest(F.lit(0.0), self.width) * F.greatest(F.lit(0.0), self.height)

    def struct(self) -> Column:
        return F.struct(*(c.cast("double").alias(n) for n, c in zip(self._fields, self, strict=True)))

    def named(self, prefix: str = "") -> list[Column]:
        return [c.alias(prefix + n) for n, c in zip(self._fields, self, strict=True)]

    def holds(self, x: Column, y: Column, slack: float = 0.0) -> Column:
        """The point lies within, borders included."""
        return (x >= self.x0 - slack) & (x <= self.x1 + slack) & (y >= self.top - slack) & (y <= self.bottom + slack)


def clamp(value: Column, low: float | Column, high: float | Column) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.greatest(lit(low), F.least(lit(high), value))


def overlap_ratio(a: Box, b: Box) -> Column:
    """Shared area over the smaller area, areas of at least 0.1."""
    wide = F.greatest(F.lit(0.0), F.least(a.x1, b.x1) - F.greatest(a.x0, b.x0))
    high = F.greatest(F.lit(0.0), F.least(a.bottom, b.bottom) - F.greatest(a.top, b.top))
    return wide * high / F.least(F.greatest(F.lit(0.1), a.area), F.greatest(F.lit(0.1), b.area))


def page_share(box: Box, width: Column, height: Column) -> Column:
    return box.area / F.greatest(F.lit(1.0), width * height)


def inset(box: Box, across: Column | float, down: Column | float) -> Box:
    """The box drawn in on each side; a direction in which it would invert stays."""
    across, down = (v if isinstance(v, Column) else F.lit(v) for v in (across, down))
    fits_x, fits_y = box.width > 2 * across, box.height > 2 * down
    return Box(
        F.when(fits_x, box.x0 + across).otherwise(box.x0), F.when(fits_y, box.top + down).otherwise(box.top),
        F.when(fits_x, box.x1 - across).otherwise(box.x1), F.when(fits_y, box.bottom - down).otherwise(box.bottom),
    )


def padded(box: Box, across: Column | float, down: Column | float) -> Box:
    return Box(box.x0 - across, box.top - down, box.x1 + across, box.bottom + down)


def clipped(box: Box, to: Box) -> Box:
    return Box(F.greatest(box.x0, to.x0), F.greatest(box.top, to.top), F.least(box.x1, to.x1), F.least(box.bottom, to.bottom))


def from_thousandths(box: Box, region: Box) -> Box:
    """A box given in thousandths of a region, in the region's own coordinates."""
    x = lambda v: region.x0 + v / 1000 * region.width
    y = lambda v: region.top + v / 1000 * region.height
    return Box(x(box.x0), y(box.top), x(box.x1), y(box.bottom))


def valid_thousandths(box: Box, least_side: float = 2.0) -> Column:
    """The box clamped to 0..1000 as a struct, or null if a side is then too short or a value is missing."""
    held = Box(*(clamp(c.cast("double"), 0.0, 1000.0) for c in box))
    whole = box.x0.isNotNull() & box.top.isNotNull() & box.x1.isNotNull() & box.bottom.isNotNull()
    return F.when(whole & (held.width >= least_side) & (held.height >= least_side), held.struct())


def line_font_size(height: Column, newlines: Column, share: float = 1.0, low: float = 6.0, high: float = 18.0) -> Column:
    """The size that fills a box of that height with its lines."""
    return clamp(F.greatest(F.lit(1.0), height) / (newlines + 1) * share, low, high)


def luminance(r: Column, g: Column, b: Column) -> Column:
    return 0.2126 * r + 0.7152 * g + 0.0722 * b


def contrast_text(r: Column, g: Column, b: Column) -> Column:
    """White on dark ground (luminance under 0.42), else black; as one grey level, 1.0 or 0.0."""
    return F.when(luminance(r, g, b) < 0.42, F.lit(1.0)).otherwise(F.lit(0.0))


def unit_rgb(color: Column) -> Column:
    """One grey level or three and more components as r, g, b held to 0..1; null for anything else."""
    held = F.transform(color, lambda c: clamp(c.cast("double"), 0.0, 1.0))
    at = lambda i: F.get(held, i)
    grey = F.struct(at(F.lit(0)).alias("r"), at(F.lit(0)).alias("g"), at(F.lit(0)).alias("b"))
    full = F.struct(at(F.lit(0)).alias("r"), at(F.lit(1)).alias("g"), at(F.lit(2)).alias("b"))
    return F.when(F.size(color) == 1, grey).when(F.size(color) >= 3, full)


def looks_white(color: Column) -> Column:
    """Grey or RGB all at least 0.95, CMYK all at most 0.05."""
    n = F.size(color)
    return F.when(n.isin(1, 3), F.array_min(color) >= 0.95).when(n == 4, F.array_max(color) <= 0.05).otherwise(False)


def looks_dark(color: Column) -> Column:
    """Grey at most 0.2, RGB all at most 0.3, CMYK with a component of at least 0.7."""
    n = F.size(color)
    return F.when(n == 1, F.array_max(color) <= 0.2).when(n == 3, F.array_max(color) <= 0.3).when(n == 4, F.array_max(color) >= 0.7).otherwise(False)


def visible_edge(stroke: Column, fill: Column, stroking: Column, filling: Column) -> Column:
    """A stroked edge shows unless it is white, a filled one if it is dark, any other always."""
    return F.when(F.coalesce(stroke, F.lit(False)), ~F.coalesce(looks_white(stroking), F.lit(False))).when(F.coalesce(fill, F.lit(False)), F.coalesce(looks_dark(filling), F.lit(False))).otherwise(True)


def cell_text_box(cell: Box) -> Box:
    """Where text stands in a table cell: drawn in by 2 % (0.6 to 1.5) across and 8 % (0.5 to 1.2) down."""
    return Box(
        cell.x0 + clamp(cell.width * 0.02, 0.6, 1.5), cell.top + clamp(cell.height * 0.08, 0.5, 1.2),
        cell.x1 - clamp(cell.width * 0.02, 0.6, 1.5), cell.bottom - clamp(cell.height * 0.08, 0.5, 1.2),
    )


def cell_font_size(text_box: Box, lines: Column, is_header: Column) -> Column:
    return clamp(text_box.height / F.greatest(F.lit(1), lines) * 0.66, 4.5, F.when(is_header, 11.0).otherwise(8.0))


def backoff_seconds(attempt: Column) -> Column:
    return F.least(F.lit(4.0), 0.5 * F.pow(F.lit(2.0), attempt))
