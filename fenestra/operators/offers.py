"""Printed offer forms: sub-units, price lines and their arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fenestra.functions import text as tx
from fenestra.functions.binding import bind

# fixed value: allowed rounding of a line total
LINE_TOLERANCE = 0.5


def _segments(text: Column) -> Column:
    """Page text cut before each sub-unit heading: ``struct<prefix, blocks>``."""
    parts = F.split(text, rf"(?={tx.PROFILE_MARK})")
    headed = text.startswith(tx.PROFILE_MARK)
    return bind(parts, lambda p: F.struct(
        F.when(headed, F.lit("")).otherwise(p[0]).alias("prefix"),
        F.when(headed, p).when(F.size(p) > 1, F.slice(p, 2, F.size(p))).otherwise(F.array(text))
        .alias("blocks"), (headed | (F.size(p) > 1)).alias("headed")))


def offer_blocks(pages: DataFrame, ro_scope: str = "block") -> DataFrame:
    """One row per sub-unit of the offer pages of ``pages(doc_id, page_no, text)``.

    Every price block is used. A sub-unit belongs to the price block that closes
    it (the next one on the page), or to the block before it where the page
    starts with its price; a page with one price block gives it to all its
    sub-units. ``ro_scope="page"`` gives each sub-unit the first rough opening of
    the page, ``"block"`` only its own.
    """
    offers = pages.where(F.col("text").contains("Frame size:"))
    keep = [c for c in pages.columns if c != "text"]
    cut = offers.withColumn("_s", _segments(F.col("text"))).withColumn(
        "_prices", tx.price_blocks(F.col("text"))).withColumn(
        "_page_ro", tx.field_dimensions(F.col("text"), tx.ROUGH_OPENING_FIELD))
    count = lambda c: F.size(F.regexp_extract_all(c, F.lit(tx.PRICE_BLOCK), F.lit(0)))
    cut = cut.withColumn("_counts", F.transform(F.col("_s.blocks"), count)).withColumn(
        "_lead", F.when(F.col("_s.headed"), count(F.col("_s.prefix"))).otherwise(0))
    rows = cut.select(*keep, "_prices", "_page_ro", "_counts", "_lead",
                      F.posexplode("_s.blocks").alias("_i", "block"))
    before = F.col("_lead") + F.aggregate(
        F.slice("_counts", F.lit(1), F.col("_i")), F.lit(0), lambda a, x: a + x)
    line = F.when(F.col("_lead") > 0, before - 1).otherwise(before)
    rows = rows.withColumn("line_no", F.when(F.size("_prices") > 0, F.greatest(
        F.lit(0), F.least(line, F.size("_prices") - 1)))).withColumn(
        "_price", F.get("_prices", F.col("line_no")))
    frame = tx.field_dimensions(F.col("block"), tx.FRAME_FIELD)
    ro = tx.field_dimensions(F.col("block"), tx.ROUGH_OPENING_FIELD) if ro_scope == "block" else F.col("_page_ro")
    rows = rows.withColumns({
        "_frame": frame, "_ro": ro,
        "item": F.coalesce(F.col("_price.item"), F.col("page_no").cast("string"))})
    return rows.select(
        *keep, F.col("_i").alias("block_no"), "line_no", "item",
        F.col("_frame.w").alias("frame_w"), F.col("_frame.h").alias("frame_h"),
        F.col("_ro.w").alias("ro_w"), F.col("_ro.h").alias("ro_h"),
        F.coalesce("_price.qty", F.lit(0)).alias("qty"), tx.glass_kind(F.col("block")).alias("glass"),
        F.col("block").rlike(tx.EGRESS_FIELD).alias("egress"),
        F.col("_price.unit_price").alias("unit_price"), F.col("_price.line_total").alias("line_total"))


def number_blocks(blocks: DataFrame) -> DataFrame:
    """Add ``mark``: ``item.j`` where a price line covers several sub-units, else ``item``.

    The window runs over the sub-units of one price line of one page.
    """
    line = Window.partitionBy("doc_id", "page_no", "line_no")
    j = F.row_number().over(line.orderBy("block_no"))
    several = F.count(F.lit(1)).over(line) > 1
    return blocks.withColumn("mark", F.when(several, F.concat_ws(
        ".", F.col("item"), j.cast("string"))).otherwise(F.col("item")))


def offer_lines(pages: DataFrame) -> DataFrame:
    """Every price line with its arithmetic check: unit price times quantity against the total."""
    offers = pages.where(F.col("text").contains("Frame size:"))
    keep = [c for c in pages.columns if c != "text"]
    lines = offers.select(*keep, F.posexplode(tx.price_blocks(F.col("text"))).alias("line_no", "_l")).select(
        *keep, "line_no", "_l.*")
    return check_lines(lines)


def check_lines(lines: DataFrame) -> DataFrame:
    """Add ``ok``; a line with a missing or zero figure cannot be checked and gets NULL."""
    double = lambda c: F.col(c).cast("double")
    usable = (double("unit_price") != 0) & (double("qty") != 0) & (double("line_total") != 0)
    gap = F.abs(double("unit_price") * double("qty") - double("line_total"))
    return lines.withColumn("ok", F.when(usable, gap < LINE_TOLERANCE))


def reconcile(lines: DataFrame, scope: list[str]) -> DataFrame:
    """Per document: checked lines, total quantity, agreement and coverage.

    ``reconciled`` says that every checked line adds up; ``coverage`` says how
    many of the lines seen could be checked.
    """
    checked = F.col("ok").isNotNull()
    return lines.groupBy(*scope).agg(
        F.count(F.lit(1)).alias("lines_seen"), F.count_if(checked).alias("lines_checked"),
        F.count_if(~F.col("ok")).alias("lines_failed"),
        F.coalesce(F.sum(F.when(checked, F.col("qty").cast("bigint"))), F.lit(0)).alias("total_qty")
    ).withColumn("reconciled", (F.col("lines_checked") > 0) & (F.col("lines_failed") == 0)).withColumn(
        "coverage", F.col("lines_checked") / F.col("lines_seen"))


def offer_schema(blocks: DataFrame) -> DataFrame:
    """Numbered sub-units under the common column names."""
    return blocks.select(
        "doc_id", "page_no", "mark", F.col("frame_w").alias("width"), F.col("frame_h").alias("height"),
        F.col("ro_w").alias("rough_opening_width"), F.col("ro_h").alias("rough_opening_height"),
        "qty", "glass", "egress")
