"""Quantity provenance and data-quality findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# fixed values: how a quantity can have been obtained, and the largest plausible size
QTY_SOURCES = ("price_reconciled", "schedule_column", "vlm_read", "counted_openings", "unknown")
MAX_SIZE_IN = 600


def stamp_qty_source(units: DataFrame, source: str) -> DataFrame:
    """Fill ``qty_source`` where a unit does not carry one."""
    if source not in QTY_SOURCES:
        raise ValueError(f"unknown qty source {source!r}")
    given = F.col("qty_source") if "qty_source" in units.columns else F.lit(None).cast("string")
    return units.withColumn("qty_source", F.coalesce(given, F.lit(source)))


def implausible(size: Column) -> Column:
    return (size <= 0) | (size > MAX_SIZE_IN)


def unit_findings(units: DataFrame) -> DataFrame:
    """Add ``errors`` and ``warnings`` (rule names) to units with mark, qty, qty_source, width, height."""
    named = lambda rules: F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules]))
    source = F.coalesce("qty_source", F.lit("unknown"))
    return units.withColumns({
        "errors": named([("implausible width", implausible(F.col("width"))),
                         ("implausible height", implausible(F.col("height")))]),
        "warnings": named([("qty missing", F.col("qty").isNull()),
                           ("qty without provenance", F.col("qty").isNotNull() & (source == "unknown"))])})


def long_findings(checked: DataFrame, scope: list[str]) -> DataFrame:
    """One row per finding: scope, mark, severity, rule."""
    tag = lambda kind: F.transform(kind, lambda r: F.struct(
        F.lit("error" if kind == "errors" else "warning").alias("severity"), r.alias("rule")))
    return checked.select(*scope, "mark", F.explode(F.concat(tag("errors"), tag("warnings"))).alias("f")).select(
        *scope, "mark", "f.severity", "f.rule")


def quality_summary(checked: DataFrame, scope: list[str], lines: DataFrame | None = None,
                    unscored: DataFrame | None = None) -> DataFrame:
    """Errors, warnings and verdict per document.

    Failed price lines are one error of their document. A document in
    ``unscored`` without any warning gets one.
    """
    out = checked.groupBy(*scope).agg(
        F.count(F.lit(1)).alias("n_units"), F.sum(F.size("errors")).cast("bigint").alias("n_errors"),
        F.sum(F.size("warnings")).cast("bigint").alias("n_warnings"))
    if lines is not None:
        failed = lines.groupBy(*scope).agg(F.count_if(~F.col("ok")).alias("_failed"))
        zero = lambda c: F.coalesce(F.col(c), F.lit(0))
        out = out.join(failed, scope, "full_outer").withColumn("n_units", zero("n_units")).withColumn(
            "n_errors", zero("n_errors") + F.when(zero("_failed") > 0, 1).otherwise(0)).withColumn(
            "n_warnings", zero("n_warnings")).drop("_failed")
    if unscored is not None:
        mark = unscored.select(*scope).distinct().withColumn("_unscored", F.lit(True))
        silent = F.coalesce("_unscored", F.lit(False)) & (F.col("n_warnings") == 0)
        out = out.join(mark, scope, "left").withColumn(
            "n_warnings", F.when(silent, 1).otherwise(F.col("n_warnings"))).drop("_unscored")
    return out.withColumn("ok", F.col("n_errors") == 0).withColumn(
        "n_flagged", F.col("n_errors") + F.col("n_warnings"))
