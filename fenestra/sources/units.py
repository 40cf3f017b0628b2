"""Units as JSON lines, ground truth files and model responses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from fenestra.functions.geometry import box_from_array
from fenestra.functions.text import model_slug
from fenestra.schemas import TRUTH_FILE, UNIT_JSON

_CORRUPT = "_corrupt"
#: Units of one file at most.
MAX_FILE_UNITS = 500_000


def _evidence_to_struct(df: DataFrame) -> DataFrame:
    return df.withColumn("evidence", F.transform("evidence", lambda e: F.struct(
        e["page"].alias("page"), e["region"].alias("region"), box_from_array(e["bbox"]).alias("bbox"))))


def _evidence_to_json(df: DataFrame) -> DataFrame:
    return df.withColumn("evidence", F.transform("evidence", lambda e: F.struct(
        e["page"].alias("page"), e["region"].alias("region"),
        F.array(*[e["bbox"][n] for n in "xywh"]).alias("bbox"))))


def with_unit_defaults(df: DataFrame) -> DataFrame:
    """Confidence 1 and empty lists where a stored unit leaves them out."""
    empty = lambda c: F.coalesce(F.col(c), F.array().cast(df.schema[c].dataType))
    return df.withColumns({"confidence": F.coalesce("confidence", F.lit(1.0)), **{
        c: empty(c) for c in ("panels", "source_marks", "evidence", "flags", "discovery_gaps")}})


def read_units(spark: SparkSession, path: str) -> DataFrame:
    """Units with a ``reject`` column: unparseable lines and lines without id, kind or qty."""
    schema = T.StructType(UNIT_JSON.fields + [T.StructField(_CORRUPT, T.StringType())])
    raw = spark.read.schema(schema).option("mode", "PERMISSIVE").option(
        "columnNameOfCorruptRecord", _CORRUPT).json(path)
    missing = F.concat_ws(", ", *[F.when(F.col(c).isNull(), F.lit(c)) for c in ("unit_id", "kind", "qty")])
    reject = F.when(F.col(_CORRUPT).isNotNull(), F.lit("unparseable line")).when(
        missing != "", F.concat(F.lit("missing "), missing))
    return with_unit_defaults(_evidence_to_struct(raw.withColumn("reject", reject).drop(_CORRUPT)))


def write_units(units: DataFrame, path: str, partition_by: list[str] | None = None,
                mode: str = "error") -> None:
    """JSON lines below ``variant=/project=/model=`` style folders.

    A model name is made safe for a path first. The files are compressed, and short enough to be read by a task each.
    """
    parts = partition_by or []
    out = units.withColumn("model", model_slug(F.col("model"))) if "model" in parts else units
    names = [f.name for f in UNIT_JSON.fields if f.name in units.columns]
    out = out.select(*parts, *names)
    if "evidence" in names:
        out = _evidence_to_json(out)
    out.write.mode(mode).option("maxRecordsPerFile", MAX_FILE_UNITS).partitionBy(*parts).json(path, compression="gzip")


def read_truth(spark: SparkSession, path: str, gt_level: str) -> DataFrame:
    """Ground truth files -> one row per unit, with project, level and the frame total."""
    files = spark.read.schema(TRUTH_FILE).option("multiLine", True).json(path)
    rows = files.select(F.col("project"), F.lit(gt_level).alias("gt_level"),
                        F.col("totals.frames").cast("bigint").alias("true_frames"),
                        F.explode("units").alias("u")).select("project", "gt_level", "true_frames", "u.*")
    return with_unit_defaults(_evidence_to_struct(rows))


def read_transcript(spark: SparkSession, path: str, source: str, field: str = "window_schedule") -> DataFrame:
    """Transcript file -> ``(source, row_no, cells)`` with headings as they were written."""
    schema = T.StructType([T.StructField(field, T.ArrayType(T.MapType(T.StringType(), T.StringType())))])
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    return rows.select(F.lit(source).alias("source"), F.posexplode(field).alias("row_no", "cells"))


def write_variants(variants: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Injected variants, one folder per variant."""
    variants.write.mode(mode).partitionBy("variant_id").json(path)


def write_report(rows: DataFrame, path: str, version: str, mode: str = "overwrite") -> None:
    """Result rows as JSON with the time of writing and a version."""
    rows.withColumns({"generated": F.current_timestamp(), "version": F.lit(version)}).write.mode(mode).json(path)
