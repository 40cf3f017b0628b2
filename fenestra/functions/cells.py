"""Schedule-table cells: vocabularies and typed values."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from fenestra.functions.binding import one_of, to_number
from fenestra.functions.inches import inches_value, strip

# fixed values: header and yes/no vocabularies of the two readers, v1 (strict) and v2 (lenient)
HEADERS = {
    "v1": ("mark", "size", "width", "height", "type", "glass", "u-factor", "u factor", "egress"),
    "v2": ("mark", "size", "width", "height", "type", "glass", "u-factor", "u factor", "ufactor",
           "egress", "qty", "quantity"),
}
MIN_HEADER_HITS = {"v1": 1, "v2": 2}
YES = {"v1": ("y", "yes", "true"), "v2": ("y", "yes", "true", "x")}
NO = {"v1": ("n", "no", "false"), "v2": ("n", "no", "false", "-")}
SIZE_HEADERS = {"v1": ("size", "size (w x h)"), "v2": ("size",)}
QTY_HEADERS = {"v1": ("qty", "quantity", "count"), "v2": ("qty", "quantity")}
UFACTOR_HEADERS = {"v1": ("u-factor", "u factor"), "v2": ("u-factor", "u factor", "ufactor")}


def heading(c: Column) -> Column:
    return F.lower(strip(F.coalesce(c, F.lit(""))))


def is_schedule_header(headings: Column, vocab: str = "v1") -> Column:
    """Enough known headings in the first row of a table."""
    hits = F.filter(headings, lambda h: one_of(h, HEADERS[vocab]))
    return F.size(hits) >= MIN_HEADER_HITS[vocab]


def pick_cell(cells: Column, names: tuple[str, ...]) -> Column:
    """First present, non-empty cell among the headings; column 0 counts like any other."""
    return F.coalesce(*[F.nullif(F.try_element_at(cells, F.lit(n)), F.lit("")) for n in names])


def cell_glass(cell: Column) -> Column:
    low = F.lower(cell)
    return (F.when(low.contains("temp"), "tempered").when(low.contains("ann"), "annealed")
            .when(low.contains("mix"), "mixed"))


def cell_egress(cell: Column, vocab: str = "v1") -> Column:
    low = F.lower(cell)
    return F.when(low.isin(*YES[vocab]), F.lit(True)).when(low.isin(*NO[vocab]), F.lit(False))


def cell_ufactor(cell: Column) -> Column:
    """First blank-separated token as a number."""
    return to_number(F.regexp_extract(cell, r"^\s*(\S+)", 1))


def cell_qty(cell: Column) -> Column:
    """Whole number, 1 when absent or unreadable."""
    return F.coalesce(to_number(strip(cell), "int"), F.lit(1))


def cell_size(size: Column, width: Column, height: Column, vocab: str = "v1") -> Column:
    """``struct<w, h>`` from a ``W x H`` cell, else from the width and height columns.

    Where a ``W x H`` cell cannot be read, ``v2`` takes those columns too; in ``v1`` the size stays unknown.
    """
    low = F.lower(size)
    paired = low.contains("x")
    first = F.when(paired, inches_value(F.regexp_extract(low, r"(?s)^(.*?)x", 1)))
    second = F.when(paired, inches_value(F.regexp_extract(low, r"(?s)^.*?x(.*)$", 1)))
    own = lambda pair, column: (F.coalesce(pair, inches_value(column)) if vocab == "v2"
                                else F.when(F.coalesce(paired, F.lit(False)), pair).otherwise(inches_value(column)))
    return F.struct(own(first, width).alias("w"), own(second, height).alias("h"))


def mark_kind(mark: Column) -> Column:
    return F.when(F.upper(mark).startswith("D"), "door").otherwise("window")
