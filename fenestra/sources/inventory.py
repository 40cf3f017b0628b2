"""Pre-flight inventory of expected documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# fixed value: largest accepted document
MAX_BYTES = 120 * 1024 * 1024


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Names and sizes below ``path``; the content column is never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option(
        "pathGlobFilter", pattern).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "path",
                        F.col("length").alias("n_bytes"), F.col("modificationTime").alias("mtime"))


def inventory(expected: DataFrame, files: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Status of every expected name: MISSING, TOO_LARGE or OK."""
    sized = files.groupBy("name").agg(F.max("n_bytes").alias("n_bytes"))
    return expected.select("name").distinct().join(sized, "name", "left").withColumn(
        "status", F.when(F.col("n_bytes").isNull(), "MISSING")
        .when(F.col("n_bytes") > max_bytes, "TOO_LARGE").otherwise("OK"))
