"""Declared schemas of the nested tables (no inference anywhere)."""

from __future__ import annotations

from pyspark.sql import types as T

PANEL = T.StructType([
    T.StructField("role", T.StringType()),
    T.StructField("width_in", T.DoubleType()),
    T.StructField("height_in", T.DoubleType()),
    T.StructField("glass", T.StringType()),
    T.StructField("u_factor", T.DoubleType()),
    T.StructField("egress", T.BooleanType()),
    T.StructField("clear_opening_sqft", T.DoubleType()),
])
ROUGH_OPENING = T.StructType([
    T.StructField("w_in", T.DoubleType()),
    T.StructField("h_in", T.DoubleType()),
])
#: On disk a box is a JSON array of four numbers; in tables it is a struct.
EVIDENCE_JSON = T.StructType([
    T.StructField("page", T.IntegerType()),
    T.StructField("region", T.StringType()),
    T.StructField("bbox", T.ArrayType(T.DoubleType())),
])
BOX = T.StructType([T.StructField(n, T.DoubleType()) for n in ("x", "y", "w", "h")])
EVIDENCE = T.StructType([
    T.StructField("page", T.IntegerType()),
    T.StructField("region", T.StringType()),
    T.StructField("bbox", BOX),
])

#: One unit per line, as written by the JSONL sink.
UNIT_JSON = T.StructType([
    T.StructField("unit_id", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("panels", T.ArrayType(PANEL)),
    T.StructField("qty", T.IntegerType()),
    T.StructField("source_marks", T.ArrayType(T.StringType())),
    T.StructField("color_interior", T.StringType()),
    T.StructField("color_exterior", T.StringType()),
    T.StructField("rough_opening", ROUGH_OPENING),
    T.StructField("evidence", T.ArrayType(EVIDENCE_JSON)),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("flags", T.ArrayType(T.StringType())),
    T.StructField("discovery_gaps", T.ArrayType(T.StringType())),
])

#: Optional attributes read by the rule checks.
AUGMENTED = {
    "sill_height_in": T.DoubleType(),
    "adjacent_door": T.BooleanType(),
    "room_label": T.StringType(),
    "facade_count": T.IntegerType(),
    "tempered_zone": T.BooleanType(),
    "tempered_required": T.BooleanType(),
}

TRUTH_FILE = T.StructType([
    T.StructField("project", T.StringType()),
    T.StructField("level", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("verification_status", T.StringType()),
    T.StructField("totals", T.StructType([
        T.StructField("units", T.IntegerType()),
        T.StructField("frames", T.IntegerType()),
    ])),
    T.StructField("units", T.ArrayType(UNIT_JSON)),
    T.StructField("plan_only_marks", T.ArrayType(T.StringType())),
])

#: Superset of leaderboard columns, name -> SQL type.
LEADERBOARD = {
    **{c: "string" for c in ("variant", "model", "project", "gt_level", "status", "error",
                             "traceback", "artifact", "first_error")},
    **{c: "double" for c in ("elapsed_sec", "cost_usd", "group_f1", "group_precision",
                             "group_recall", "qty_mae", "unit_count_error", "frame_count_error",
                             "glass_acc", "ufactor_acc", "egress_acc", "hallucination_rate",
                             "miss_rate")},
    **{c: "bigint" for c in ("n_units", "n_groups", "matched_groups", "fp_groups", "fn_groups",
                             "pred_units_total", "gt_units_total", "errors_count")},
}
