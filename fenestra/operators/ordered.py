"""Row numbers and running totals that hold up when one group has most rows.

A window sorts each group in one task. Where a group is too large for that, rows
are split by range on (group, order), each piece is numbered on its own, and the
pieces' totals are added up afterwards; the number of pieces is the number of
range partitions, whatever the data size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fenestra.session import stage

#: Rows of one group that a single task may sort.
MAX_GROUP_ROWS = 2_000_000
#: Buckets in which groups are counted together.
BUCKETS = 16_384


def has_large_group(df: DataFrame, keys: list[str], limit: int) -> bool:
    """Whether a group has more than ``limit`` rows; only the answer reaches the driver.

    Groups are first counted together in ``BUCKETS`` buckets, which are reduced to that many rows before the shuffle. A group
    is no larger than its bucket, so only where a bucket is too large each group is counted.
    """
    over = lambda *by: not df.groupBy(*by).count().where(F.col("count") > limit).limit(1).isEmpty()
    return over(F.pmod(F.hash(*keys), F.lit(BUCKETS))) and over(*keys) if keys else over()


def _pieces(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *[F.col(k).asc() for k in keys], *order)
    # staged, so that the piece of a row cannot change when a task is run again
    return stage(ranged.withColumn("_piece", F.spark_partition_id()), "pieces")


def _offsets(pieces: DataFrame, keys: list[str], total: Column) -> DataFrame:
    """Sum over the earlier pieces of the same group: at most one row per piece and group."""
    w = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    sums = pieces.groupBy(*keys, "_piece").agg(total.alias("_sum"))
    return sums.withColumn("_before", F.coalesce(F.sum("_sum").over(w), F.lit(0))).drop("_sum")


def _join_offsets(pieces: DataFrame, offsets: DataFrame, keys: list[str]) -> DataFrame:
    a, b = pieces.alias("a"), offsets.alias("b")
    on = F.col("a._piece") == F.col("b._piece")
    for k in keys:
        on = on & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return a.join(b, on).select("a.*", "b._before")


def row_numbers(df: DataFrame, keys: list[str], order: list[Column], name: str,
                max_group_rows: int = MAX_GROUP_ROWS, bound_by: DataFrame | None = None) -> DataFrame:
    """Add the 1-based position of each row in its group.

    ``bound_by`` is a table with at least as many rows per group that is cheaper
    to count than ``df``.
    """
    if not has_large_group(df if bound_by is None else bound_by, keys, max_group_rows):
        return df.withColumn(
            name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint"))
    pieces = _pieces(df, keys, order)
    inside = F.row_number().over(Window.partitionBy(*keys, "_piece").orderBy(*order))
    joined = _join_offsets(pieces, _offsets(pieces, keys, F.count(F.lit(1))), keys)
    return joined.withColumn(name, inside + F.col("_before")).drop("_piece", "_before")


def running_totals(df: DataFrame, keys: list[str], order: list[Column], value: Column, name: str,
                   max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Add the total of ``value`` over the rows before this one (0 for the first).

    ``order`` must be unique within a group. Use a decimal value where the
    result has to be exact.
    """
    df = df.withColumn("_value", value)
    span = lambda *extra: Window.partitionBy(*keys, *extra).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, -1)
    if not has_large_group(df, keys, max_group_rows):
        return df.withColumn(name, F.coalesce(F.sum("_value").over(span()), F.lit(0))).drop("_value")
    pieces = _pieces(df, keys, order)
    joined = _join_offsets(pieces, _offsets(pieces, keys, F.sum("_value")), keys)
    inside = F.coalesce(F.sum("_value").over(span("_piece")), F.lit(0))
    return joined.withColumn(name, inside + F.col("_before")).drop("_piece", "_before", "_value")


def top_rows(df: DataFrame, keys: list[str], order: list[Column], k: int,
             name: str = "rank") -> DataFrame:
    """First ``k`` rows per group; each task keeps at most ``k`` rows of a group before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(name, rank).where(F.col(name) <= k)
