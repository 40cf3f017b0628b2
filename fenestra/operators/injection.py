"""Known defects put into a clean truth table, to test the rule checks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from fenestra.operators import rules
from fenestra.operators.rules import augmented


@dataclass(frozen=True)
class Defect:
    """One variant: which units it touches and what it changes.

    ``edit`` maps a column name to its new value; it is called lazily, because
    columns need a running session. ``plan_mark`` adds a mark to the plan only.
    """

    variant_id: str
    id: str
    defect_type: str
    expected_flag: str
    description: str
    target: str | None = None
    edit: Callable[[], dict[str, Column]] = field(default=dict)
    plan_mark: str | None = None
    where: Callable[[], Column] | None = None

    def touches(self) -> Column:
        if self.where is not None:
            return self.where()
        return F.col("unit_id") == self.target if self.target else F.lit(False)


def first_panel(**values: object) -> Callable[[], dict[str, Column]]:
    """Edit fields of the first panel."""
    def build() -> dict[str, Column]:
        def change(p: Column, i: Column) -> Column:
            edited = reduce(lambda acc, kv: acc.withField(kv[0], kv[1]), [
                (n, F.lit(v).cast(t)) for n, (v, t) in typed.items()], p)
            return F.when(i == 0, edited).otherwise(p)
        typed = {n: (v, "string" if n in ("role", "glass") else "boolean" if n == "egress" else "double")
                 for n, v in values.items()}
        return {"panels": F.transform("panels", change)}
    return build


def both(*edits: Callable[[], dict[str, Column]]) -> Callable[[], dict[str, Column]]:
    return lambda: {k: v for e in edits for k, v in e().items()}


def attribute(**values: object) -> Callable[[], dict[str, Column]]:
    return lambda: {n: F.lit(v) for n, v in values.items()}


def keep_panels(n: int) -> Callable[[], dict[str, Column]]:
    return lambda: {"panels": F.slice("panels", 1, n)}


# fixed values: the ten defects and their targets
DEFECTS = [
    Defect("v01_size_mismatch_W2", "inj01", "SIZE_MISMATCH_SCHEDULE_VS_ELEVATION", rules.SIZE_MISMATCH,
           "first panel 50 in wide", "W2", first_panel(width_in=50.0)),
    Defect("v02_tempered_required_W4", "inj02", "TEMPERED_REQUIRED_BUT_ANNEALED", rules.NEAR_DOOR_ANNEALED,
           "annealed next to a door", "W4", both(first_panel(glass="annealed"), attribute(adjacent_door=True))),
    Defect("v03_egress_fail_W3", "inj03", "EGRESS_FAIL_BEDROOM", rules.EGRESS_UNDERSIZE,
           "bedroom opening of 4.5 sq ft", "W3",
           both(first_panel(clear_opening_sqft=4.5), attribute(room_label="bedroom"))),
    Defect("v04_mark_not_in_schedule", "inj04", "MARK_ON_PLAN_NOT_IN_SCHEDULE", rules.MARK_MISSING,
           "plan mark without a schedule row", plan_mark="W9"),
    Defect("v05_qty_mismatch_W1", "inj05", "QTY_MISMATCH_FACADE_VS_SCHEDULE", rules.FACADE_MISMATCH,
           "60 on the facade", "W1", attribute(facade_count=60)),
    Defect("v06_low_sill_no_temp", "inj06", "SILL_HEIGHT_LESS_THAN_24_NO_TEMP", rules.LOW_SILL_ANNEALED,
           "annealed above a 12 in sill", "W2", both(first_panel(glass="annealed"), attribute(sill_height_in=12.0))),
    Defect("v07_ufactor_high", "inj07", "U_FACTOR_BELOW_ENERGY_TABLE", rules.UFACTOR_BREACH,
           "U-factor of 0.30", "W5", first_panel(u_factor=0.30)),
    Defect("v08_composite_panel_drop", "inj08", "COMPOSITE_PANEL_COUNT_DROP", rules.PANEL_COUNT,
           "third panel left out", "U2", keep_panels(2)),
    Defect("v09_egress_tempered_conflict", "inj09", "EGRESS_TRUE_BUT_TEMPERED_REQUIRED", rules.TEMPERED_CONFLICT,
           "annealed egress where tempered is required", "W6",
           both(first_panel(egress=True, glass="annealed"), attribute(tempered_required=True))),
    Defect("v10_missing_glass_temp_zone", "inj10", "MISSING_GLASS_TYPE_ON_TEMP_ZONE", rules.ZONE_WITHOUT_GLASS,
           "no glass in a tempered zone", "W7", both(first_panel(glass=None), attribute(tempered_zone=True))),
]


def inject(units: DataFrame, defects: list[Defect] | None = None) -> DataFrame:
    """Every variant of the truth: one copy of the rows per defect, with its edit applied.

    The variants are exploded from an array inside the scan, so there is no join
    and no shuffle; ``injected`` marks the touched rows.
    """
    chosen = DEFECTS if defects is None else defects
    units = augmented(units)
    out = units.withColumn("variant_id", F.explode(F.array(*[F.lit(d.variant_id) for d in chosen])))
    hit = {d.variant_id: (F.col("variant_id") == d.variant_id) & d.touches() for d in chosen}
    changed: dict[str, Column] = {}
    for d in chosen:
        for name, value in d.edit().items():
            if not isinstance(units.schema[name].dataType, T.ArrayType):
                value = value.cast(units.schema[name].dataType)
            changed[name] = F.when(hit[d.variant_id], value).otherwise(changed.get(name, F.col(name)))
    changed["injected"] = F.coalesce(reduce(lambda a, b: a | b, hit.values()), F.lit(False))
    return out.withColumns(changed)


def injections(variants: DataFrame, scope: list[str], defects: list[Defect] | None = None) -> DataFrame:
    """Expected flag of each touched unit, and of each plan-only mark per scope."""
    chosen = DEFECTS if defects is None else defects
    spec = lambda name: F.create_map(*[F.lit(x) for d in chosen for x in (d.variant_id, getattr(d, name))])
    described = lambda df, target: df.select(
        *scope, "variant_id", spec("id")[F.col("variant_id")].alias("id"),
        spec("defect_type")[F.col("variant_id")].alias("defect_type"), target.alias("target_unit_id"),
        spec("expected_flag")[F.col("variant_id")].alias("expected_flag"))
    marked = described(variants.where("injected"), F.col("unit_id"))
    return marked.unionByName(described(
        plan_marks(variants, scope, chosen), F.col("mark")))


def plan_marks(variants: DataFrame, scope: list[str], defects: list[Defect] | None = None) -> DataFrame:
    """Marks that a variant shows on the plan only, per scope."""
    pairs = [(d.variant_id, d.plan_mark) for d in (DEFECTS if defects is None else defects) if d.plan_mark]
    if not pairs:
        return variants.select(*scope, "variant_id", F.lit("").alias("mark")).where(F.lit(False))
    marks = F.create_map(*[F.lit(x) for pair in pairs for x in pair])
    return variants.select(*scope, "variant_id").where(
        F.col("variant_id").isin([v for v, _ in pairs])).distinct().withColumn(
        "mark", marks[F.col("variant_id")])


def baseline_of(units: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(panel counts, first-panel sizes) of a clean table, to check variants against."""
    first = F.get("panels", F.lit(0))
    return (units.where("kind = 'composite'").select(*key, F.size("panels").alias("ref_panel_count")),
            units.where(F.size("panels") > 0).select(
                *key, first["width_in"].alias("ref_width_in"), first["height_in"].alias("ref_height_in")))
