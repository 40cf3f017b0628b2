"""Building-code rule checks over augmented units, evaluated in one scan."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from fenestra.functions.geometry import clear_opening_sqft
from fenestra.schemas import AUGMENTED

# fixed values: code limits and flag names
MIN_CLEAR_OPENING_SQFT = 5.7
MIN_SILL_IN = 18
MAX_FACADE_DIFFERENCE = 1
MAX_UFACTOR = 0.27
UFACTOR_SLACK = 1e-9
SIZE_TOLERANCE_IN = 1.0
LARGE_ANNEALED_SQFT = 9.0
EGRESS_UNDERSIZE = "irc_r310_egress_undersize"
NEAR_DOOR_ANNEALED = "irc_r308_4_violation"
LOW_SILL_ANNEALED = "irc_r308_4_low_sill_annealed"
ZONE_WITHOUT_GLASS = "missing_glass_type_tempered_zone"
TEMPERED_CONFLICT = "egress_tempered_conflict"
FACADE_MISMATCH = "qty_mismatch_facade_schedule"
MARK_MISSING = "mark_missing_from_schedule"
PANEL_COUNT = "composite_panel_count_mismatch"
SIZE_MISMATCH = "size_mismatch_schedule_elevation"
UFACTOR_BREACH = "ufactor_breaches_r402_1_1"
LIKELY_TEMPERED = "irc_r308_4_likely_tempered_required"


def _any_panel(test: Callable[[Column], Column]) -> Column:
    return F.exists("panels", lambda p: F.coalesce(test(p), F.lit(False)))


def _annealed(p: Column) -> Column:
    return p["glass"] == "annealed"


def _yes(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def augmented(units: DataFrame) -> DataFrame:
    """Add the optional attributes that are absent, as NULL columns."""
    missing = {n: F.lit(None).cast(t) for n, t in AUGMENTED.items() if n not in units.columns}
    return units.withColumns(missing) if missing else units


def unit_rules(max_ufactor: float = MAX_UFACTOR, zone_annealed: bool = False) -> list[tuple[str, Column]]:
    """(flag, condition) pairs over one unit; extend the list to add a rule.

    ``zone_annealed`` also flags annealed glass in a tempered zone.
    """
    bedroom = F.lower(F.coalesce("room_label", F.lit(""))) == "bedroom"
    small = lambda p: p["clear_opening_sqft"] < MIN_CLEAR_OPENING_SQFT
    zone = lambda p: p["glass"].isNull() | (_annealed(p) if zone_annealed else F.lit(False))
    return [
        (EGRESS_UNDERSIZE, _any_panel(lambda p: (F.coalesce(p["egress"], F.lit(False)) | bedroom) & small(p))),
        (NEAR_DOOR_ANNEALED, _yes("adjacent_door") & _any_panel(_annealed)),
        (LOW_SILL_ANNEALED, (F.col("sill_height_in") < MIN_SILL_IN) & _any_panel(_annealed)),
        (ZONE_WITHOUT_GLASS, _yes("tempered_zone") & _any_panel(zone)),
        (TEMPERED_CONFLICT, _yes("tempered_required") & _any_panel(_annealed)),
        (FACADE_MISMATCH, F.abs(F.col("facade_count") - F.coalesce("qty", F.lit(0))) > MAX_FACADE_DIFFERENCE),
        (UFACTOR_BREACH, _any_panel(lambda p: p["u_factor"] > max_ufactor + UFACTOR_SLACK)),
    ]


def reference_rules(tolerance_in: float = SIZE_TOLERANCE_IN) -> list[tuple[str, Column]]:
    """Rules that use the columns ``ref_panel_count``, ``ref_width_in`` and ``ref_height_in``."""
    panels = F.greatest(F.size("panels"), F.lit(0))
    first = F.get("panels", F.lit(0))
    off = lambda name, ref: F.abs(F.coalesce(first[name], F.lit(0.0)) - F.col(ref)) > tolerance_in
    return [
        (PANEL_COUNT, (F.col("kind") == "composite") & (
            (panels < 2) | F.coalesce(panels != F.col("ref_panel_count"), F.lit(False)))),
        (SIZE_MISMATCH, (panels > 0) & (off("width_in", "ref_width_in") | off("height_in", "ref_height_in"))),
    ]


def inline_rules() -> list[tuple[str, Column]]:
    """Geometry rules applied to consensus units, where no sill or room is known."""
    return [
        (EGRESS_UNDERSIZE, _any_panel(lambda p: p["egress"] & (p["clear_opening_sqft"] < MIN_CLEAR_OPENING_SQFT))),
        (LIKELY_TEMPERED, _any_panel(lambda p: _annealed(p) & (
            clear_opening_sqft(p["width_in"], p["height_in"]) > LARGE_ANNEALED_SQFT))),
        (PANEL_COUNT, (F.col("kind") == "composite") & (F.size("panels") < 2)),
    ]


def flag_array(rules: list[tuple[str, Column]]) -> Column:
    """Flags raised on a row, in rule order, each at most once."""
    return F.array_compact(F.array(*[F.when(test, F.lit(flag)) for flag, test in rules]))


def with_references(units: DataFrame, panel_counts: DataFrame | None, baseline: DataFrame | None,
                    key: list[str]) -> DataFrame:
    """Left-join expected panel counts and baseline sizes on ``key``.

    ``panel_counts``: key, ref_panel_count. ``baseline``: key, ref_width_in,
    ref_height_in. Spark picks the join from their sizes.
    """
    for table, columns in ((panel_counts, {"ref_panel_count": "int"}),
                           (baseline, {"ref_width_in": "double", "ref_height_in": "double"})):
        if table is None:
            units = units.withColumns({c: F.lit(None).cast(t) for c, t in columns.items()})
        else:
            units = units.join(table.select(*key, *columns), key, "left")
    return units


def check_units(units: DataFrame, key: list[str] | None = None, panel_counts: DataFrame | None = None,
                baseline: DataFrame | None = None, max_ufactor: float = MAX_UFACTOR) -> DataFrame:
    """Add ``check_flags``: every rule in one projection, joins only for given references."""
    ready = with_references(augmented(units), panel_counts, baseline, key or ["unit_id"])
    return ready.withColumn("check_flags", flag_array(unit_rules(max_ufactor) + reference_rules())).drop(
        "ref_panel_count", "ref_width_in", "ref_height_in")


def missing_marks(plan_marks: DataFrame, units: DataFrame, scope: list[str]) -> DataFrame:
    """Plan marks without a schedule row, as findings."""
    known = units.select(*scope, F.col("unit_id").alias("mark"))
    return plan_marks.join(known, [*scope, "mark"], "left_anti").select(
        *scope, F.col("mark").alias("unit_id"), F.lit(MARK_MISSING).alias("flag")).distinct()


def findings(checked: DataFrame, scope: list[str], *more: DataFrame) -> DataFrame:
    """Long (scope, unit, flag) table without repeats, from the flag arrays and other findings."""
    rows = checked.select(*scope, "unit_id", F.explode("check_flags").alias("flag"))
    return reduce(DataFrame.unionByName, more, rows).distinct()


def findings_by_unit(long: DataFrame, scope: list[str]) -> DataFrame:
    """Sorted flags per unit; at most one entry per known flag."""
    return long.groupBy(*scope, "unit_id").agg(F.array_sort(F.collect_set("flag")).alias("flags"))
