"""Tables behind a review view: formatted units and boxes per page."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fenestra.functions.text import DASH, fixed


def _general(v):
    """Number without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(v.cast("decimal(18,4)").cast("string"), r"0+$", ""), r"\.$", "")


def unit_review(units: DataFrame) -> DataFrame:
    """Sizes, confidence, flags and gaps of each unit as display text."""
    listed = lambda c: F.when(F.size(c) > 0, F.array_join(c, ", ")).otherwise(F.lit(DASH))
    sizes = F.transform("panels", lambda p: F.concat(_general(p["width_in"]), F.lit("×"), _general(p["height_in"])))
    return units.withColumns({
        "size": F.array_join(sizes, ", "), "conf": fixed(F.col("confidence"), 2),
        "flags_text": listed("flags"), "gaps_text": listed("discovery_gaps")})


def page_boxes(units: DataFrame, pages: DataFrame) -> DataFrame:
    """One labelled box per piece of evidence, joined to its page of ``pages(doc_id, page_no)``."""
    marked = units.select("doc_id", "unit_id", "kind", F.concat(
        F.col("unit_id"), F.lit(" ("), F.col("qty").cast("string"), F.lit(")")).alias("label"),
        F.explode("evidence").alias("e")).select(
        "doc_id", F.col("e.page").cast("bigint").alias("page_no"), "unit_id", "kind", "label", "e.bbox.*")
    return marked.join(pages, ["doc_id", "page_no"])
