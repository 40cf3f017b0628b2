"""The four processing branches and their common result table."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from fenestra.operators import offers, quality, routing
from fenestra.operators.matching import match_units
from fenestra.operators.metrics import score_matches
from fenestra.operators.responses import page_reads
from fenestra.operators.schedules import schedule_units
from fenestra.operators.leaderboard import short_gate
from fenestra.session import staged_path

# fixed value: confidence of a page read, from the lowest
CONFIDENCE = ("low", "medium", "high")


def offer_branch(pages: DataFrame, ro_scope: str = "block") -> tuple[DataFrame, DataFrame]:
    """Branch 1: (numbered sub-units, checked price lines) of printed offers."""
    return offers.number_blocks(offers.offer_blocks(pages, ro_scope)), offers.offer_lines(pages)


def schedule_branch(rows: DataFrame, truth: DataFrame, scope: list[str], profile: str = "weather_shield",
                    f1: float = 0.70) -> DataFrame:
    """Branch 2: decode schedule rows, match them to the truth and gate the score."""
    return short_gate(score_matches(match_units(schedule_units(rows, profile), truth, scope), scope), f1)


def _read_pages(responses: DataFrame, chosen: DataFrame) -> DataFrame:
    return page_reads(responses.join(chosen.select("doc_id", "page_no"), ["doc_id", "page_no"], "left_semi"))


def elevation_branch(pages: DataFrame, responses: DataFrame, k: int = 2) -> DataFrame:
    """Branch 3: page reads of the densest elevation sheets."""
    return _read_pages(responses, routing.elevation_pages(pages, k))


def handwritten_branch(pages: DataFrame, responses: DataFrame, k: int = 3) -> DataFrame:
    """Branch 4: page reads of sampled pages."""
    return _read_pages(responses, routing.sample_pages(pages, k))


def read_summary(reads: DataFrame) -> DataFrame:
    """Confidence, readability and number of units per page read."""
    return reads.select("doc_id", "page_no", "confidence", "readable", F.size("units").alias("n_units"))


def read_units(reads: DataFrame, source: str) -> DataFrame:
    """Units of page reads with their provenance."""
    rows = reads.select("doc_id", F.col("page_no").alias("source_page"), F.explode("units").alias("u")).select(
        "doc_id", "source_page", "u.mark", "u.qty", F.col("u.width_in").alias("width"),
        F.col("u.height_in").alias("height"))
    return quality.stamp_qty_source(rows, source)


def fan_out(pages: DataFrame, routes: DataFrame) -> Callable[[int], DataFrame]:
    """Pages of one branch: all are written once, partitioned by branch, and each branch reads its partition only."""
    routed = pages.join(routes.select("doc_id", "branch"), "doc_id")
    path = staged_path(pages.sparkSession, "routed")
    routed.write.partitionBy("branch").parquet(path)
    written = pages.sparkSession.read.schema(routed.schema).parquet(path)
    return lambda number: written.where(F.col("branch") == number).drop("branch")


def _checked(units: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    return quality.quality_summary(quality.unit_findings(units), ["doc_id"], lines).select(
        "doc_id", "n_units", "n_errors", "n_warnings", "ok")


def offer_summary(pages: DataFrame) -> DataFrame:
    """Branch 1 per document: units with quantities from the price lines, and how the lines add up."""
    blocks, lines = offer_branch(pages.select("doc_id", "page_no", "text"))
    units = quality.stamp_qty_source(offers.offer_schema(blocks), "price_reconciled")
    added = offers.reconcile(lines, ["doc_id"]).select("doc_id", "total_qty", "reconciled", F.col("lines_seen").alias("offer_lines"))
    return _checked(units, lines).join(added, "doc_id", "left")


def schedule_summary(rows: DataFrame, truth: DataFrame) -> DataFrame:
    """Branch 2 per document: decoded rows scored against the truth; quality is not looked at."""
    gated = schedule_branch(rows, truth, ["doc_id"])
    return gated.select("doc_id", F.col("pred_units_total").alias("n_units"), F.lit(True).alias("scored"), "group_f1", "gate")


def elevation_summary(pages: DataFrame) -> DataFrame:
    """Branch 3 per document: openings counted on the densest sheets."""
    reads = elevation_branch(pages.select("doc_id", "page_no", "text"), pages.select("doc_id", "page_no", "raw_text"))
    return _checked(read_units(reads, "counted_openings"))


def handwritten_summary(pages: DataFrame) -> DataFrame:
    """Branch 4 per document: units of sampled pages, and the lowest confidence of a page."""
    reads = handwritten_branch(pages.select("doc_id", "page_no"), pages.select("doc_id", "page_no", "raw_text"))
    rank = F.coalesce(F.array_position(F.array(*[F.lit(c) for c in CONFIDENCE]), F.col("confidence")), F.lit(0))
    lowest = reads.groupBy("doc_id").agg(F.min_by("confidence", F.struct(rank, "confidence")).alias("confidence"))
    return lowest.join(_checked(read_units(reads, "vlm_read")), "doc_id", "left")


def run_branches(routes: DataFrame, pages: DataFrame, truth: DataFrame) -> dict[int, DataFrame]:
    """Summaries of all four branches over ``pages(doc_id, page_no, text, raw_text, rows)``.

    ``text`` is the page's text, ``raw_text`` the answer to a reading of the page, ``rows`` the schedule rows transcribed from it
    (mark, size_code, qty, type); ``truth`` holds the units of documents with a schedule.
    """
    branch = fan_out(pages, routes)
    return {1: offer_summary(branch(1)), 2: schedule_summary(branch(2).select("doc_id", F.inline("rows")), truth.join(
        branch(2).select("doc_id").distinct(), "doc_id", "left_semi")),
        3: elevation_summary(branch(3)), 4: handwritten_summary(branch(4))}


def branch_results(routes: DataFrame, summaries: dict[int, DataFrame]) -> DataFrame:
    """One row per routed document: what the branch that read it found.

    ``summaries`` maps a branch number to ``(doc_id, n_units, ...)``; figures that a branch does not have are NULL.
    """
    parts = [s.withColumn("branch", F.lit(b)) for b, s in summaries.items()]
    united = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    joined = routes.select("doc_id", "branch", "branch_name").join(united, ["doc_id", "branch"], "left")
    return joined.withColumns({"n_units": F.coalesce("n_units", F.lit(0)), "scored": F.coalesce("scored", F.lit(False))})
