"""Spec-group keys and grouped quantities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fenestra.functions.inches import round_dim, round_steps, ufactor_bucket

DEFAULT_BUCKET = 0.5


def key_panels(panels: Column, bucket: float = DEFAULT_BUCKET, mode: str = "full") -> Column:
    """Panels as they enter the group key, ordered by (role, width, height).

    The position is part of the sort so that equal-size panels keep their order
    (a stable sort); it is dropped again afterwards. ``mode="full"`` keeps glass,
    U-factor bucket and egress in the key, ``mode="dims"`` leaves them NULL.
    """
    def entry(p: Column, i: Column) -> Column:
        full = mode == "full"
        extra = lambda c, kind: c if full else F.lit(None).cast(kind)
        return F.struct(
            p["role"].alias("role"), round_dim(p["width_in"], bucket).alias("w"),
            round_dim(p["height_in"], bucket).alias("h"), i.alias("i"),
            extra(p["glass"], "string").alias("glass"),
            extra(ufactor_bucket(p["u_factor"]), "string").alias("u_bucket"),
            extra(p["egress"], "boolean").alias("egress"))

    return F.transform(F.array_sort(F.transform(panels, entry)), lambda p: F.struct(
        *[p[n].alias(n) for n in ("role", "w", "h", "glass", "u_bucket", "egress")]))


def key_text(kind: Column, panels: Column, bucket: float = DEFAULT_BUCKET) -> Column:
    """Readable form of a key; sizes are bucket counts, so it is exact. NULL without panels to show."""
    shown = lambda c: F.coalesce(c.cast("string"), F.lit("-"))
    one = lambda p: F.concat_ws(
        ":", shown(p["role"]), shown(round_steps(p["w"], bucket)), shown(round_steps(p["h"], bucket)),
        shown(p["glass"]), shown(p["u_bucket"]), shown(p["egress"]))
    return F.when(panels.isNotNull(), F.concat_ws("|", kind, F.concat_ws("+", F.transform(panels, one))))


def with_key(units: DataFrame, bucket: float = DEFAULT_BUCKET, mode: str = "full") -> DataFrame:
    """Add ``key_panels``; with ``kind`` it forms the group key."""
    return units.withColumn("key_panels", key_panels(F.col("panels"), bucket, mode))


def group_units(units: DataFrame, scope: list[str], bucket: float = DEFAULT_BUCKET,
                mode: str = "full") -> DataFrame:
    """Total quantity per spec group within ``scope``; mirror pairs fold.

    A plain sum, so a key that holds most rows is reduced before the shuffle.
    """
    return with_key(units, bucket, mode).groupBy(*scope, "kind", "key_panels").agg(
        F.sum(F.col("qty").cast("bigint")).alias("qty"), F.count(F.lit(1)).alias("n_units"))


def distinct_groups(units: DataFrame, scope: list[str], heights: bool = False) -> DataFrame:
    """Number of distinct (kind, widths) or (kind, (width, height)) groups per scope."""
    shape = F.transform(F.col("panels"), lambda p: F.struct(
        p["width_in"], p["height_in"]) if heights else p["width_in"])
    return units.select(*scope, F.struct("kind", shape).alias("shape")).groupBy(*scope).agg(
        F.count_distinct("shape").alias("n_groups"))
