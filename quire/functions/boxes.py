"""Boxes: page points (origin bottom left), unit rectangles (origin top left), 0-1000 OCR boxes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import clamp


def finite(*columns: Column) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return F.coalesce(out, F.lit(False))


def page_rect(bbox: Column, width: Column, height: Column) -> Column:
    """[x, y, w, h] of a block as unit rectangle, six decimals; null if a number is missing."""
    x, y, w, h = (F.get(bbox, F.lit(i)) for i in range(4))
    parts = [x / width, (height - y - h) / height, w / width, h / height]
    whole = (F.size(bbox) == 4) & finite(x, y, w, h, width, height) & (width != 0) & (height != 0)
    return F.when(whole, F.array(*[F.round(clamp(p, 0.0, 1.0), 6) for p in parts]))


def unit_rect(rect: Column) -> Column:
    """A rectangle of four numbers held to 0..1; null if it is not one."""
    sane = (F.size(rect) == 4) & F.forall(rect, lambda v: finite(v))
    return F.when(sane, F.transform(rect, lambda v: F.round(clamp(v, 0.0, 1.0), 6)))


def ocr_bbox_to_page(bbox: Column, width: Column, height: Column) -> Column:
    """A top-left box in thousandths (or in 0..1, then perhaps by corners) as page points; malformed: the whole page."""
    x, y, w, h = (clamp(F.coalesce(F.get(bbox, F.lit(i)).cast("double"), F.lit(0.0)), 0.0, 1000.0) for i in range(4))
    small = F.greatest(x, y, w, h) <= 1
    corner = small & (w > x) & (h > y)
    scale = F.when(small, 1000.0).otherwise(1.0)
    w, h = F.when(corner, w - x).otherwise(w) * scale, F.when(corner, h - y).otherwise(h) * scale
    x, y = x * scale, y * scale
    w, h = F.greatest(F.lit(0.0), F.least(1000 - x, w)), F.greatest(F.lit(0.0), F.least(1000 - y, h))
    box = F.array(*[F.round(v, 2) for v in (x / 1000 * width, (1000 - y - h) / 1000 * height, w / 1000 * width, h / 1000 * height)])
    return F.when(bbox.isNotNull() & (F.size(bbox) == 4), box).otherwise(F.array(F.lit(0.0), F.lit(0.0), width, height))


def repair_legacy_box(bbox: Column, width: Column, height: Column, is_ocr: Column) -> Column:
    """Boxes that an older scaling wrote a thousand times too small, scaled back; others stay."""
    x, y, right, low = (F.get(bbox, F.lit(i)) for i in range(4))
    legacy = is_ocr & (F.size(bbox) == 4) & finite(x, y, right, low) & (x <= width * 0.01) & (right <= width * 0.01) & (y >= height * 0.9) & (low <= height * 0.01)
    x0 = clamp(x * 1000, 0.0, width)
    x1 = F.greatest(x0, F.least(width, right * 1000))
    top = clamp((height - y - low) * 1000, 0.0, height)
    bottom = F.greatest(top, F.least(height, low * 1000))
    fixed = F.array(*[F.round(v, 2) for v in (x0, F.greatest(F.lit(0.0), height - bottom), F.greatest(F.lit(1.0), x1 - x0), F.greatest(F.lit(1.0), bottom - top))])
    return F.when(F.coalesce(legacy, F.lit(False)), fixed).otherwise(bbox)
