"""Incremental batch work that may be repeated without harm."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

def read_or_empty(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """Table at ``path``, or no rows if it does not exist yet."""
    try:
        return spark.read.schema(like.schema).parquet(path)
    except AnalysisException:
        return like.limit(0)


def _same(keys: list[str]) -> list:
    return [F.col(k).eqNullSafe(F.col(f"_done_{k}")) for k in keys]


def pending(requested: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Requested work that is not done yet; null keys are keys like others."""
    return requested.join(done.select(*[F.col(k).alias(f"_done_{k}") for k in keys]).distinct(), _same(keys), "left_anti")


def append_pending(requested: DataFrame, path: str, keys: list[str], work=lambda df: df, first: list[str] | None = None) -> None:
    """Append ``work`` of the pending rows; a second call with the same request adds nothing.

    A key that is requested twice is worked on once: the first row by ``first``, by all other columns if it is not given.
    ``work`` keeps the keys.
    """
    rest = [c for c in requested.columns if c not in keys]
    if rest:
        once = F.min_by(F.struct(*rest), F.struct(*(first or rest)))
        requested = requested.groupBy(*keys).agg(once.alias("_r")).select(*keys, "_r.*")
    else:
        requested = requested.distinct()
    result = work(requested)
    done = read_or_empty(requested.sparkSession, path, result)
    work(pending(requested, done, keys)).write.mode("append").parquet(path)
