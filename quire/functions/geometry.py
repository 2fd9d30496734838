"""Scalar functions over boxes (x1, y1, x2, y2), as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box:
    """The four sides of a box, from columns with a common suffix or prefix."""

    def __init__(self, x1: Column, y1: Column, x2: Column, y2: Column):
        self.x1, self.y1, self.x2, self.y2 = x1, y1, x2, y2

    @classmethod
    def of(cls, suffix: str = "", prefix: str = "") -> Box:
        return cls(*(F.col(f"{prefix}{c}{suffix}") for c in ("x1", "y1", "x2", "y2")))

    @property
    def width(self) -> Column:
        return self.x2 - self.x1

    @property
    def height(self) -> Column:
        return self.y2 - self.y1

    @property
    def area(self) -> Column:
        return F.greatest(self.width, F.lit(0)) * F.greatest(self.height, F.lit(0))

    @property
    def cx(self) -> Column:
        return (self.x1 + self.x2) / 2.0

    @property
    def cy(self) -> Column:
        return (self.y1 + self.y2) / 2.0

    def clamp(self, width: Column, height: Column) -> Box:
        in_ = lambda v, most: F.greatest(F.lit(0), F.least(v, most))
        return Box(in_(self.x1, width), in_(self.y1, height), in_(self.x2, width), in_(self.y2, height))

    def grow(self, by: Column | float) -> Box:
        return Box(self.x1 - by, self.y1 - by, self.x2 + by, self.y2 + by)

    def struct(self) -> Column:
        return F.struct(self.x1.alias("x1"), self.y1.alias("y1"), self.x2.alias("x2"), self.y2.alias("y2"))

    def xywh(self) -> Column:
        return F.struct(self.x1.alias("x"), self.y1.alias("y"), self.width.alias("w"), self.height.alias("h"))


def from_xywh(x: Column, y: Column, w: Column, h: Column) -> Box:
    return Box(x, y, x + w, y + h)


def intersection(a: Box, b: Box) -> Column:
    """Common area; 0 if apart or touching."""
    w = F.greatest(F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1), F.lit(0))
    h = F.greatest(F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1), F.lit(0))
    return w * h


def overlap_ratio(a: Box, b: Box) -> Column:
    """Common area over the smaller area (1 at least)."""
    return intersection(a, b) / F.greatest(F.least(a.area, b.area), F.lit(1))


def overlap_1d(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    return F.greatest(F.least(a2, b2) - F.greatest(a1, b1), F.lit(0))


def contains_text(container: Box, text: Box, margin: float = 6, share: float = 0.55) -> Column:
    """The text's centre is in the container with a margin, and so is ``share`` of its area."""
    c = container.grow(margin)
    inside = text.cx.between(c.x1, c.x2) & text.cy.between(c.y1, c.y2)
    return inside & (intersection(container, text) >= share * F.greatest(text.area, F.lit(1)))


def connector_on_border(part: Box, container: Box) -> Column:
    """A thin or corner part that lies inside a container along its edge."""
    short = F.least(container.width, container.height)
    band = F.least(F.greatest(F.bround(0.22 * short), F.lit(4)), F.lit(14))
    inside = intersection(part, container) >= 0.8 * F.greatest(part.area, F.lit(1))
    near_x = (part.cx - container.x1 <= band) | (container.x2 - part.cx <= band)
    near_y = (part.cy - container.y1 <= band) | (container.y2 - part.cy <= band)
    long_, thin = F.greatest(part.width, part.height), F.least(part.width, part.height)
    elongated = (long_ >= 12) & (long_ >= 2 * F.greatest(thin, F.lit(1)))
    return inside & (near_x | near_y) & (elongated | (near_x & near_y))


def scaled(value: float, page_height: Column, area: bool = False, reference: float = 720) -> Column:
    """A threshold tuned for a page of ``reference`` pixels: lengths are rounded and 1 at least, areas are not."""
    s = page_height / reference
    return value * s * s if area else F.greatest(F.lit(1), F.bround(value * s))


def letterbox(box: Box, width: Column, height: Column, canvas_width: float, canvas_height: float) -> Column:
    """A box in source pixels placed on a canvas: one scale, centred."""
    s = F.least(canvas_width / width, canvas_height / height)
    dx, dy = (canvas_width - width * s) / 2, (canvas_height - height * s) / 2
    return F.struct((box.x1 * s + dx).alias("x1"), (box.y1 * s + dy).alias("y1"), (box.x2 * s + dx).alias("x2"), (box.y2 * s + dy).alias("y2"), s.alias("scale"))


def unletterbox(box: Box, width: Column, height: Column, canvas_width: float, canvas_height: float) -> Column:
    """The inverse in whole pixels: low corner down, high corner up."""
    s = F.least(canvas_width / width, canvas_height / height)
    dx, dy = (canvas_width - width * s) / 2, (canvas_height - height * s) / 2
    return F.struct(F.floor((box.x1 - dx) / s).alias("x1"), F.floor((box.y1 - dy) / s).alias("y1"), F.ceil((box.x2 - dx) / s).alias("x2"), F.ceil((box.y2 - dy) / s).alias("y2"))


def relative(box: Box, container: Box) -> Column:
    """A box in units of its container."""
    w, h = F.greatest(container.width, F.lit(1)), F.greatest(container.height, F.lit(1))
    return F.struct(((box.x1 - container.x1) / w).alias("x1"), ((box.y1 - container.y1) / h).alias("y1"), ((box.x2 - container.x1) / w).alias("x2"), ((box.y2 - container.y1) / h).alias("y2"))


def outline_native(box: Box) -> Column:
    aspect = box.width / F.greatest(box.height, F.lit(1))
    return (aspect >= 1.45) | (aspect <= 0.69)


def badge_number(text: Column, box: Box) -> Column:
    aspect = box.width / F.greatest(box.height, F.lit(1))
    return text.rlike(r"^\s*\d{1,3}\s*$") & (box.height >= 24) & aspect.between(0.65, 1.6)


def icon_like(box: Box, page_area: Column) -> Column:
    aspect = box.width / F.greatest(box.height, F.lit(1))
    return (F.least(box.width, box.height) >= 24) & (box.area <= 0.4 * page_area) & aspect.between(0.25, 4.0)
