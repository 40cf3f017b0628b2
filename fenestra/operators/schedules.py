"""Schedule tables and transcribed schedule rows -> units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fenestra.functions import cells as ce
from fenestra.functions.binding import bind
from fenestra.functions.codes import decode
from fenestra.functions.inches import strip
from fenestra.operators.ordered import MAX_GROUP_ROWS, has_large_group, row_numbers

_TABLE = ["doc_id", "page_no", "table_no"]

# fixed value: confidence of a unit read from a vector table
TABLE_CONFIDENCE = 0.95


def table_headers(cells: DataFrame, vocab: str = "v1") -> DataFrame:
    """Heading -> column position map of each schedule table; the last of equal headings counts.

    ``cells(doc_id, page_no, table_no, row_no, col_no, text)``, row 0 holds the headings.
    """
    top = cells.where("row_no = 0").withColumn("heading", ce.heading(F.col("text")))
    last = top.groupBy(*_TABLE, "heading").agg(F.max("col_no").alias("col_no"))
    # as many entries as the table has columns
    maps = last.groupBy(*_TABLE).agg(F.map_from_entries(F.collect_list(F.struct("heading", "col_no"))).alias("columns"))
    return maps.where(ce.is_schedule_header(F.map_keys("columns"), vocab))


def _columns(row: Column) -> Column:
    """Heading -> column position of a heading row, an array of (col_no, text); the last of equal headings counts."""
    named = F.transform(row, lambda c: F.struct(ce.heading(c["text"]).alias("heading"), c["col_no"].alias("col_no")))
    last = lambda cells, h: F.array_max(F.transform(F.filter(cells, lambda c: c["heading"] == h), lambda c: c["col_no"]))
    return bind(named, lambda cells: F.map_from_entries(F.transform(
        F.array_distinct(F.transform(cells, lambda c: c["heading"])),
        lambda h: F.struct(h.alias("heading"), last(cells, h).alias("col_no")))))


def _named_rows(cells: DataFrame, vocab: str) -> DataFrame:
    """Rows with the headings of their table, where no document has more rows than a task may sort.

    Cells are shuffled once, by document; rows, headings and positions are found inside it.
    """
    known = cells.where(F.col("row_no") >= 0).dropna(subset=_TABLE).repartition("doc_id")
    rows = known.groupBy(*_TABLE, "row_no").agg(F.collect_list(F.struct("col_no", "text")).alias("_row"))
    text = lambda c: strip(F.coalesce(c["text"], F.lit("")))
    by_column = F.map_from_entries(F.transform("_row", lambda c: F.struct(c["col_no"].alias("col_no"), text(c).alias("text"))))
    # both maps are made below the window: what is used in a lambda is otherwise made again for each of its elements
    maps = rows.select(*_TABLE, "row_no", F.when(F.col("row_no") == 0, _columns(F.col("_row"))).alias("_heads"),
                       F.when(F.col("row_no") > 0, by_column).alias("_by_column"))
    known_heads = F.when(ce.is_schedule_header(F.map_keys("_heads"), vocab), F.col("_heads"))
    table = Window.partitionBy(*_TABLE).orderBy("row_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    headed = maps.withColumn("_heads", known_heads).withColumn("columns", F.first("_heads").over(table))
    return headed.where((F.col("row_no") > 0) & F.col("columns").isNotNull()).drop("_heads")


def table_rows(cells: DataFrame, vocab: str = "v1", bound_by: DataFrame | None = None,
               max_document_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Rows of schedule tables as heading -> text maps, with the text of column 0.

    ``bound_by`` has a row per table row or more, with ``doc_id``, and is cheaper to count than ``cells``.
    Where a document is too long for a task, cells are gathered per row, not per table, so a long table is
    spread over tasks; headers are then joined once per row.
    """
    counted = cells.where("col_no = 0 and row_no > 0") if bound_by is None else bound_by
    if not has_large_group(counted, ["doc_id"], max_document_rows):
        named = _named_rows(cells, vocab)
    else:
        body = cells.where("row_no > 0").withColumn("text", strip(F.coalesce("text", F.lit(""))))
        rows = body.groupBy(*_TABLE, "row_no").agg(
            F.map_from_entries(F.collect_list(F.struct("col_no", "text"))).alias("_by_column"))
        named = rows.join(table_headers(cells, vocab), _TABLE)
    return named.select(
        *_TABLE, "row_no", F.transform_values("columns", lambda h, c: F.try_element_at("_by_column", c)).alias("cells"),
        F.try_element_at("_by_column", F.lit(0)).alias("first_cell"),
        F.map_contains_key("columns", F.lit("mark")).alias("has_mark"))


def _sized_rows(cells: DataFrame, vocab: str, bound_by: DataFrame | None, max_document_rows: int) -> DataFrame:
    cell = lambda *names: ce.pick_cell(F.col("cells"), names)
    size = ce.cell_size(cell(*ce.SIZE_HEADERS[vocab]), cell("width"), cell("height"), vocab)
    # a generated column is read once; a plain one would be read again for every condition on it
    return table_rows(cells, vocab, bound_by, max_document_rows).withColumn("_size", F.explode(F.array(size)))


def table_rejects(cells: DataFrame, vocab: str = "v1", bound_by: DataFrame | None = None,
                  max_document_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Rows of schedule tables that give no unit, with their cells and the reason."""
    unread = F.concat_ws(", ", F.when(F.col("_size.w").isNull(), "width"), F.when(F.col("_size.h").isNull(), "height"))
    return _sized_rows(cells, vocab, bound_by, max_document_rows).withColumn("_unread", unread).where(F.col("_unread") != "").select(
        *_TABLE, "row_no", "cells", F.concat(F.lit("unreadable "), F.col("_unread")).alias("reject"))


def table_units(cells: DataFrame, vocab: str = "v1", bound_by: DataFrame | None = None,
                max_document_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Units of schedule tables; rows without a readable size are left out (see ``table_rejects``).

    ``v1`` and ``v2`` differ in headings, yes/no words and in what happens to a
    row without a mark (see the cell functions). ``bound_by``: see ``table_rows``.
    """
    cell = lambda *names: ce.pick_cell(F.col("cells"), names)
    rows = _sized_rows(cells, vocab, bound_by, max_document_rows).where(
        F.col("_size.w").isNotNull() & F.col("_size.h").isNotNull())
    numbered = row_numbers(rows, ["doc_id"], [F.col(c) for c in ("page_no", "table_no", "row_no")], "_n", max_document_rows,
                           bound_by=cells.where("col_no = 0 and row_no > 0") if bound_by is None else bound_by)
    fallback = F.concat(F.lit("R"), (F.col("page_no") - 1).cast("string"), F.lit("-"),
                        (F.col("_n") - 1).cast("string"))
    given = F.try_element_at("cells", F.lit("mark"))
    if vocab == "v1":
        mark = F.when(F.col("has_mark"), F.coalesce(given, F.lit(""))).otherwise(fallback)
    else:
        mark = F.coalesce(F.nullif(F.when(F.col("has_mark"), given).otherwise(F.col("first_cell")), F.lit("")),
                          fallback)
    kind = ce.mark_kind(F.col("unit_id"))
    ufactor = F.coalesce(*[ce.cell_ufactor(cell(h)) for h in ce.UFACTOR_HEADERS[vocab]])
    return numbered.withColumn("unit_id", mark).select(
        "doc_id", "page_no", "table_no", "row_no", "unit_id", kind.alias("kind"),
        F.array(F.struct(kind.alias("role"), F.col("_size.w").alias("width_in"),
                         F.col("_size.h").alias("height_in"), ce.cell_glass(cell("glass")).alias("glass"),
                         ufactor.alias("u_factor"), ce.cell_egress(cell("egress"), vocab).alias("egress"),
                         F.lit(None).cast("double").alias("clear_opening_sqft"))).alias("panels"),
        ce.cell_qty(cell(*ce.QTY_HEADERS[vocab])).alias("qty"),
        F.array("unit_id").alias("source_marks"), F.lit(TABLE_CONFIDENCE).alias("confidence"))


def decode_rows(rows: DataFrame, profile: str = "weather_shield") -> DataFrame:
    """Transcribed rows ``(mark, size_code, qty, type)`` with their decoded size.

    ``size.error`` is set on rows that cannot be decoded.
    """
    code = strip(F.coalesce(F.col("size_code").cast("string"), F.lit("")))
    return rows.withColumn("size_code", code).withColumn(
        "qty", F.coalesce(F.col("qty").try_cast("int"), F.lit(0))).withColumn(
        "kind", F.when(F.lower("type").startswith("d"), "door").otherwise("window")).withColumn(
        "size", decode(F.col("size_code"), F.lit(profile)))


def schedule_units(rows: DataFrame, profile: str = "weather_shield") -> DataFrame:
    """Decodable rows as units."""
    keep = [c for c in rows.columns if c not in ("mark", "size_code", "qty", "type")]
    ready = decode_rows(rows, profile).where(F.col("size.error").isNull())
    none = lambda t: F.lit(None).cast(t)
    return ready.select(
        *keep, F.coalesce("mark", F.lit("?")).alias("unit_id"), "kind", "qty",
        F.array(F.struct(F.col("kind").alias("role"), F.col("size.width_in").alias("width_in"),
                         F.col("size.height_in").alias("height_in"), none("string").alias("glass"),
                         none("double").alias("u_factor"), none("boolean").alias("egress"),
                         none("double").alias("clear_opening_sqft"))).alias("panels"),
        F.array(F.coalesce("mark", F.lit("")), "size_code").alias("source_marks"))


def schedule_rejects(rows: DataFrame, profile: str = "weather_shield") -> DataFrame:
    """Rows that cannot be decoded, with the reason."""
    return decode_rows(rows, profile).where(F.col("size.error").isNotNull()).select(
        *[c for c in rows.columns], F.col("size.error").alias("reject"))
