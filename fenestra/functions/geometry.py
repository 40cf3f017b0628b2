"""Boxes, tiles and areas."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# fixed values
TILE_PX = 2048
TILE_OVERLAP = 0.0
MIN_REGION_FRACTION = 0.005
MIN_REGION_SIDE = 80
MIN_CROP_SIDE = 50


def box(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(*[c.cast("double").alias(n) for c, n in zip((x, y, w, h), "xywh")])


def box_from_array(a: Column) -> Column:
    """Four-number JSON array -> struct; NULL for any other length."""
    return F.when(F.size(a) == 4, box(a[0], a[1], a[2], a[3]))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes; 0 when the union is empty."""
    zero = F.lit(0.0)
    iw = F.greatest(zero, F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"]))
    ih = F.greatest(zero, F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"]))
    union = a["w"] * a["h"] + b["w"] * b["h"] - iw * ih
    return F.when(union > 0, iw * ih / union).otherwise(zero)


def any_overlap(a: Column, b: Column, threshold: float = 0.4) -> Column:
    """Some box of array ``a`` overlaps some box of array ``b`` beyond the threshold."""
    return F.exists(a, lambda x: F.exists(b, lambda y: iou(x, y) > threshold))


def clear_opening_sqft(width_in: Column, height_in: Column) -> Column:
    return width_in * height_in / 144.0


def shift(b: Column, x: Column, y: Column) -> Column:
    """Move a crop-relative box to page coordinates."""
    return box(b["x"] + x, b["y"] + y, b["w"], b["h"])


def reanchor(evidence: Column, page_no: Column, x: Column, y: Column) -> Column:
    """Evidence in page coordinates; the page is always the one that was asked about."""
    return F.transform(evidence, lambda e: F.struct(
        page_no.cast("int").alias("page"),
        e["region"].alias("region"),
        F.when(e["bbox"].isNotNull(), shift(e["bbox"], x, y)).alias("bbox")))


def percent_box(pct: Column, width: Column, height: Column) -> Column:
    """Fractions of a page -> whole pixels (truncated); the whole page when absent."""
    p = F.when(F.size(pct) >= 4, pct).otherwise(F.array(*[F.lit(v) for v in (0.0, 0.0, 1.0, 1.0)]))
    px = lambda i, side: (p[i] * side).cast("int")
    return F.struct(px(0, width).alias("x"), px(1, height).alias("y"),
                    px(2, width).alias("w"), px(3, height).alias("h"))


def tiles(width: Column, height: Column, tile: int = TILE_PX, overlap: float = TILE_OVERLAP) -> Column:
    """Overlapping grid as an array of boxes: rows, a right-edge column and a bottom row.

    Tiles repeat where an edge tile falls on the grid, exactly as the grid is defined.
    """
    step, side = int(tile * (1 - overlap)), F.lit(tile)
    starts = lambda extent: F.sequence(
        F.lit(0), F.greatest(F.lit(1), extent.cast("int") - tile + 1) - 1, F.lit(step))
    right = F.greatest(F.lit(0), width.cast("int") - tile)
    bottom = F.greatest(F.lit(0), height.cast("int") - tile)
    columns = F.concat(starts(width), F.array(right))
    rows = F.concat(starts(height), F.array(bottom))
    at = lambda x, y: F.struct(x.alias("x"), y.alias("y"), side.alias("w"), side.alias("h"))
    return F.flatten(F.transform(rows, lambda y: F.transform(columns, lambda x: at(x, y))))


def is_region(w: Column, h: Column, page_w: Column, page_h: Column) -> Column:
    """Large enough to be a drawing region rather than noise."""
    return ((w * h >= page_w * page_h * MIN_REGION_FRACTION)
            & (w >= MIN_REGION_SIDE) & (h >= MIN_REGION_SIDE))
