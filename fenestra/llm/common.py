"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def ship(name: str) -> None:
    """Let the task functions of module ``name`` travel with the plan."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


ship(__name__)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def with_fields(df: DataFrame, keep: list[str], ddl: str) -> StructType:
    """Schema of the kept columns followed by the new ones; a new name replaces an old one."""
    new = StructType.fromDDL(ddl)
    kept = [f for f in df.select(*[F.col(f"`{c}`") for c in keep]).schema.fields if f.name not in new.names]
    return StructType([*kept, *new.fields])


def partitions(df: DataFrame) -> int:
    """The session's number of shuffle partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def by_position(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with its columns named by position, free of any name an operator uses, and the former names by the new ones."""
    names = {f"_c{i}": c for i, c in enumerate(df.columns)}
    return df.select(*[F.col(f"`{c}`").alias(n) for n, c in names.items()]), names


def name_of(names: dict[str, str], column: str) -> str:
    """The positional name of a column."""
    return next(n for n, c in names.items() if c == column)


def replaced(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with the values of existing columns exchanged; order and other columns stay."""
    return df.select(*[columns[c].alias(c) if c in columns else F.col(f"`{c}`") for c in df.columns])


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1_000) -> Iterator[None]:
    """Send at most ``rows`` rows to Python at once in the jobs that run inside; the setting is put back after."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, usual)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most ``rows`` rows, which bounds what a task makes of them at once."""
    for batch in batches:
        for start in range(0, max(1, batch.num_rows), rows):
            yield batch.slice(start, rows)


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Groups of a sorted partition, one at a time: the values of the first ``keys`` columns, and the rows."""
    held, group = None, []
    for batch in batches:
        for row in zip(*[column.to_pylist() for column in batch.columns]):
            if row[:keys] != held:
                if group:
                    yield held, group
                held, group = row[:keys], []
            group.append(row)
    if group:
        yield held, group
