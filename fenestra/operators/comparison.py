"""Two readings of the same schedule: differences and agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fenestra.functions.text import canonical_cells, canonical_key, mark_key

# fixed values: compared headings
COMPARED = ("WINDOW SIZE", "TYPE", "REMARKS", "EGRESS", "QTY", "MANUF.", "SERIES", "DAY OPEN (SF)",
            "VENT (SF)")


def index_by_mark(rows: DataFrame, order: list[str]) -> DataFrame:
    """One row per mark of ``rows(cells, order...)``; the last one in ``order`` stays.

    A largest map is found by sorting, so rows are dealt out by mark first: a task then sorts
    its share of the marks, not all maps of a file.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    marked = rows.withColumn("mark", mark_key(F.col("cells"))).where("mark <> ''").repartition(parts, "mark")
    return marked.groupBy("mark").agg(F.max_by("cells", F.struct(*order)).alias("cells"))


def diff_sources(a: DataFrame, b: DataFrame, columns: tuple[str, ...] = COMPARED) -> DataFrame:
    """Cell by cell comparison of ``(mark, cells)`` tables: mark, column, a, b, match.

    One full join on the mark; the columns are laid out afterwards, inside the row.
    """
    left = a.select("mark", canonical_cells(F.col("cells")).alias("_a"))
    right = b.select("mark", canonical_cells(F.col("cells")).alias("_b"))
    key = lambda c: canonical_key(F.lit(c))
    cell = lambda side, c: F.try_element_at(side, key(c))
    both = left.join(right, "mark", "full_outer").select("mark", "_a", "_b", F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), cell(F.col("_a"), c).alias("a"), cell(F.col("_b"), c).alias("b"))
        for c in columns])).alias("_c"))
    return both.select("mark", "_c.*").withColumn("match", F.col("a").eqNullSafe(F.col("b")))


def diff_rows(cells: DataFrame) -> DataFrame:
    """Differing columns per mark; at most one entry per compared column."""
    return cells.groupBy("mark").agg(
        F.count_if(~F.col("match")).alias("n_diffs"),
        F.array_sort(F.collect_set(F.when(~F.col("match"), F.col("column")))).alias("row_diffs"))


def diff_summary(a: DataFrame, b: DataFrame, cells: DataFrame) -> DataFrame:
    """Rows per source, common marks and differing cells, as one row."""
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    sides = a.select("mark", one.alias("a"), zero.alias("b")).unionByName(
        b.select("mark", zero.alias("a"), one.alias("b"))).groupBy("mark").agg(
        F.max("a").alias("rows_a"), F.max("b").alias("rows_b"))
    counted = sides.select("rows_a", "rows_b", (F.col("rows_a") * F.col("rows_b")).alias("rows_common"),
                           zero.alias("diff_cells"))
    differing = cells.where(~F.col("match")).select(
        *[zero.alias(c) for c in ("rows_a", "rows_b", "rows_common")], one.alias("diff_cells"))
    return counted.unionByName(differing).agg(
        *[F.coalesce(F.sum(c), zero).alias(c) for c in counted.columns])


def normalized_rows(rows: DataFrame) -> DataFrame:
    """(mark, code, qty) of schedule rows: upper-case mark, code without blanks, 0 for no quantity."""
    return rows.select(F.upper("mark").alias("mark"), F.replace("size_code", F.lit(" "), F.lit("")).alias("code"),
                       F.coalesce(F.col("qty").try_cast("int"), F.lit(0)).alias("qty"))


def agreed_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows on which both readers agree, with the row type of either reader (default window)."""
    agreed = normalized_rows(a).intersect(normalized_rows(b))
    typed = lambda df, rank: df.select(
        F.upper("mark").alias("mark"), F.replace("size_code", F.lit(" "), F.lit("")).alias("code"),
        F.col("type"), F.lit(rank).alias("_r"))
    types = typed(a, 0).unionByName(typed(b, 1)).groupBy("mark", "code").agg(
        F.max_by("type", F.struct("_r", "type")).alias("type"))
    return agreed.join(types, ["mark", "code"], "left").withColumn("type", F.coalesce("type", F.lit("window")))
