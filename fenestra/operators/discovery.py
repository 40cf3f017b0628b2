"""Extracted units -> offer form: frame sizes from rough openings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# fixed values: total reduction (width, height) in inches per unit kind; other kinds as window
SHIM_IN = {"window": (0.75, 0.75), "door": (0.75, 0.5)}


def ro_to_frame(w: Column, h: Column, kind: Column, shim_per_side_in: float | None = None) -> Column:
    """Frame size ``struct<w, h>``; a per-side shim overrides the table on both sizes."""
    if shim_per_side_in is not None:
        less = (F.lit(2.0 * shim_per_side_in), F.lit(2.0 * shim_per_side_in))
    else:
        pick = lambda i: F.when(kind == "door", SHIM_IN["door"][i]).otherwise(SHIM_IN["window"][i])
        less = (pick(0), pick(1))
    return F.struct((w - less[0]).alias("w"), (h - less[1]).alias("h"))


def to_offer_form(units: DataFrame, shim_per_side_in: float | None = None) -> DataFrame:
    """First panel takes the frame size where a rough opening is given; the rest is unchanged."""
    ro = F.col("rough_opening")
    frame = ro_to_frame(ro["w_in"], ro["h_in"], F.col("kind"), shim_per_side_in)
    change = lambda p, i: F.when(
        (i == 0) & ro.isNotNull(),
        p.withField("width_in", frame["w"]).withField("height_in", frame["h"])).otherwise(p)
    return units.withColumn("panels", F.transform("panels", change))


def both_levels(units: DataFrame) -> DataFrame:
    """The same units at the extraction and at the offer level, tagged by ``gt_level``.

    Scoring the union once replaces two scoring runs.
    """
    return units.withColumn("gt_level", F.lit("extraction")).unionByName(
        to_offer_form(units).withColumn("gt_level", F.lit("offer")))
