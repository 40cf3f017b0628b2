"""Reconcile several sources that read the same openings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from fenestra.operators import rules
from fenestra.operators.ordered import MAX_GROUP_ROWS, has_large_group, row_numbers
from fenestra.operators.spec_groups import DEFAULT_BUCKET, with_key
from fenestra.session import stage

# fixed values: sources in reading order; the first three decide the quantity
SOURCES = ("schedule", "elevation", "plan", "notes")
DECIDING = SOURCES[:3]
BASE_CONFIDENCE, CONFIDENCE_PER_SOURCE = 0.5, 0.15
MAX_SOURCE_DIFFERENCE = 1


def consensus(units: DataFrame, scope: list[str], order: list[str], bucket: float = DEFAULT_BUCKET,
              mode: str = "full", bound_by: DataFrame | None = None, max_scope_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """One row per spec group over all sources, with quantity, marks, confidence and flags.

    All figures are maxima, minima and distinct sets, so they combine before the
    shuffle. ``bound_by`` is a table with at least as many rows per scope that is cheaper to
    count: where it shows that a task can hold every scope, units are shuffled once, by scope,
    and ``with_unit_ids`` finds them in place. Panels come from the first unit seen (source order, then ``order``).
    The evidence of a group has no bound and stays a long table, see
    ``consensus_evidence``.
    """
    if _fits(bound_by, scope, max_scope_rows):
        units = units.repartition(*scope)  # before the keys, which are as long as the units
    keyed = with_key(units, bucket, mode)
    rank = reduce(lambda acc, iv: acc.when(F.col("source") == iv[1], iv[0]), list(enumerate(SOURCES))[1:],
                  F.when(F.col("source") == SOURCES[0], 0))
    first = F.struct(rank.alias("r"), *order, F.col("panels").alias("_panels"))
    of = {s: F.max(F.when(F.col("source") == s, F.col("qty"))).alias(f"qty_{s}") for s in SOURCES}
    groups = keyed.groupBy(*scope, "kind", "key_panels").agg(
        *of.values(), F.min(first).alias("_first"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("source_marks")))).alias("source_marks"))
    groups = groups.withColumns({
        "panels": F.col("_first._panels"),
        "_seen": F.struct(*[F.col(f"_first.{c}").alias(c) for c in ("r", *order)])}).drop("_first")
    deciding = [F.col(f"qty_{s}") for s in DECIDING]
    everything = [F.col(f"qty_{s}") for s in SOURCES]
    n_sources = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in everything])
    n_deciding = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in deciding])
    top, low = F.greatest(*deciding), F.least(*deciding)
    source_rules = [
        (rules.FACADE_MISMATCH, (n_deciding >= 2) & (top - low > MAX_SOURCE_DIFFERENCE)),
        (rules.MARK_MISSING, F.col("qty_schedule").isNull()
         & (F.col("qty_plan").isNotNull() | F.col("qty_elevation").isNotNull())),
    ]
    return groups.withColumns({
        "qty": F.coalesce(top, F.col("qty_notes")), "n_sources": n_sources,
        "confidence": F.least(F.lit(1.0), BASE_CONFIDENCE + CONFIDENCE_PER_SOURCE * n_sources),
        "flags": F.concat(rules.flag_array(source_rules), rules.flag_array(rules.inline_rules()))})


def _fits(bound_by: DataFrame | None, scope: list[str], most: int) -> bool:
    """Whether ``bound_by`` is given and shows that no scope has more than ``most`` rows."""
    return bound_by is not None and not has_large_group(bound_by, scope, most)


def with_unit_ids(groups: DataFrame, scope: list[str], bound_by: DataFrame | None = None,
                  max_scope_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Joined marks as id; groups without a mark are named by their position, ``F1``, ``F2``, ..."""
    if not _fits(bound_by, scope, max_scope_rows):
        # counted and numbered: staged, so that the sources are read once
        groups, bound_by = stage(groups, "consensus"), None
    numbered = row_numbers(groups, scope, [F.col("_seen"), F.col("kind"), F.col("key_panels")], "_n", max_scope_rows, bound_by)
    joined = F.nullif(F.array_join("source_marks", "|"), F.lit(""))
    return numbered.withColumn("unit_id", F.coalesce(
        joined, F.concat(F.lit("F"), F.col("_n").cast("string")))).drop("_n", "_seen")


def consensus_evidence(units: DataFrame, scope: list[str], bucket: float = DEFAULT_BUCKET,
                       mode: str = "full") -> DataFrame:
    """Every piece of evidence with the group it supports; no shuffle."""
    return with_key(units, bucket, mode).select(
        *scope, "kind", "key_panels", "source", F.explode("evidence").alias("e")).select(
        *scope, "kind", "key_panels", "source", "e.page", "e.region", "e.bbox")
