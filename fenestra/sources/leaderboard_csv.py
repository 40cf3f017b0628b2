"""Leaderboard CSV files, whose headers differ from file to file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fenestra.functions.text import safe_id
from fenestra.session import stage

_RECENCY = ["_mtime", "_path", "_line"]


def write_leaderboard(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One CSV table with its columns in name order."""
    rows.select(*sorted(rows.columns)).write.mode(mode).option("header", True).csv(path)


def write_partials(rows: DataFrame, path: str) -> None:
    """One folder per (variant, model); a later run replaces only the folders it writes."""
    named = rows.withColumns({"part_variant": safe_id(F.col("variant")), "part_model": safe_id(F.col("model"))})
    named.select("part_variant", "part_model", *sorted(rows.columns)).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").option("header", True).partitionBy(
        "part_variant", "part_model").csv(path)


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """path and names of every file's header line."""
    first = spark.read.text(path, recursiveFileLookup=True).where(F.col("_metadata.file_block_start") == 0).select(
        F.col("_metadata.file_path").alias("path"), F.col("value"), F.monotonically_increasing_id().alias("n"))
    header = first.groupBy("path").agg(F.min_by("value", "n").alias("header"))
    return header.select("path", F.transform(F.split("header", ","), lambda h: F.trim(h)).alias("names"))


def read_leaderboards(spark: SparkSession, path: str, required: tuple[str, ...] = ("variant", "model"),
                      multi_line: bool = True) -> DataFrame:
    """Rows of all files as text columns, plus ``_mtime``, ``_path`` and ``_line``.

    Reading files with different headers in one go puts values under the wrong names. So all files are read once by position,
    and a join by path gives every row the names of its own file. Only the distinct column names reach the
    driver, however many files there are. ``multi_line`` keeps quoted line breaks, but reads each file in one task.
    """
    headers = stage(read_headers(spark, path).where(F.size(F.array_intersect("names", F.array(*[F.lit(r) for r in required]))) == len(required)), "headers")
    columns = [r[0] for r in headers.select(F.explode("names").alias("c")).distinct().orderBy("c").collect()]
    if not columns:
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in required)
                                     + ", _mtime timestamp, _path string, _line bigint")
    width = headers.agg(F.max(F.size("names"))).first()[0]
    places = ", ".join(f"_c{i} string" for i in range(width))
    # a multi-line file is read by one task from start to end, as is a split, so the id follows the lines
    rows = spark.read.schema(places).option("header", True).option("multiLine", multi_line).option("recursiveFileLookup", True).csv(path).select(
        F.array(*[f"_c{i}" for i in range(width)]).alias("_values"), F.col("_metadata.file_modification_time").alias("_mtime"),
        F.col("_metadata.file_path").alias("_path"), F.monotonically_increasing_id().alias("_line"))
    named = rows.join(headers, F.col("_path") == F.col("path")).withColumn(
        "_cells", F.map_from_arrays("names", F.slice("_values", F.lit(1), F.size("names"))))
    return named.select(*[F.try_element_at("_cells", F.lit(c)).alias(c) for c in columns], "_mtime", "_path", "_line")


def merge_leaderboards(spark: SparkSession, path: str) -> DataFrame:
    """Newest row per result key over all files, with typed columns in name order."""
    from fenestra.operators.leaderboard import KEYS, latest_wins, typed
    rows = read_leaderboards(spark, path)
    absent = {k: F.lit(None).cast("string") for k in KEYS if k not in rows.columns}
    rows = rows.withColumns(absent) if absent else rows
    merged = latest_wins(rows, _RECENCY).drop(*_RECENCY)
    return typed(merged.select(*sorted(merged.columns)))
