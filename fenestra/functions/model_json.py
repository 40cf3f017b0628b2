"""Model responses: find the JSON in free text and turn it into typed units."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from fenestra.functions.binding import bind, one_of
from fenestra.functions.geometry import box
from fenestra.functions.inches import inches_value, strip

# fixed values: defaults of a unit read from a response
DEFAULT_CONFIDENCE = 0.7
DEFAULT_KIND = "window"
DEFAULT_QTY = 1
DEFAULT_REGION = "elevation"
#: How a JSON text begins; trying to parse another one costs far more than this test.
_JSON_START = r'^(?:[\[{"\-0-9]|true|false|null)'
_FENCE = r"(?s)```(?:json)?\s*(.+?)\s*```"


def balanced_span(text: Column, opening: str, closing: str) -> Column:
    """From the first ``opening`` to the bracket that balances it; NULL when there is none.

    The text is cut after each bracket and the pieces are folded with a depth
    counter, so the scan stays in the JVM and looks at the whole text.
    """
    pieces = lambda tail: F.split(tail, rf"(?<=[\{opening}\{closing}])")
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("length"), F.lit(False).alias("done"))

    def step(acc: Column, piece: Column) -> Column:
        depth = acc["depth"] + F.when(piece.endswith(opening), 1).when(
            piece.endswith(closing), -1).otherwise(0)
        moved = F.struct(depth.alias("depth"), (acc["length"] + F.length(piece)).alias("length"),
                         (depth == 0).alias("done"))
        return F.when(acc["done"], acc).otherwise(moved)

    def span(tail: Column) -> Column:
        return bind(F.aggregate(pieces(tail), start, step),
                    lambda acc: F.when(acc["done"], F.substr(tail, F.lit(1), acc["length"])))

    at = F.instr(text, opening)
    return F.when(at > 0, bind(F.substr(text, at), span))


def find_json(text: Column) -> Column:
    """JSON in a response as VARIANT: a fenced block, the whole text, or a balanced part of it."""
    fenced = F.nullif(F.regexp_extract(text, _FENCE, 1), F.lit(""))

    def search(candidate: Column) -> Column:
        part = lambda o, c: F.try_parse_json(balanced_span(candidate, o, c))
        whole = F.when(candidate.rlike(_JSON_START), F.try_parse_json(candidate))
        return F.coalesce(whole, part("[", "]"), part("{", "}"))

    # a text that is nothing but a list or an object needs no search
    within = lambda o, c: F.startswith(text, F.lit(o)) & F.endswith(text, F.lit(c))
    bare = (within("[", "]") | within("{", "}")) & ~F.contains(text, F.lit("```"))
    return F.coalesce(F.when(bare, F.try_parse_json(text)), bind(strip(F.coalesce(fenced, text)), search))


def find_json_greedy(text: Column, opening: str = "{", closing: str = "}") -> Column:
    """Widest bracketed span as VARIANT; used for single-object page reads."""
    return F.try_parse_json(F.nullif(
        F.regexp_extract(text, rf"(?s)\{opening}.*\{closing}", 0), F.lit("")))


def _read(v: Column, kind: str) -> Column:
    return F.try_variant_get(v, "$", kind)


# A path to a field that is not there costs many times as much as one that is, so objects are read as a whole,
# with one field for each name; the others are NULL.
_RO = "struct<w_in:variant,h_in:variant>"
_PANEL = ("struct<role:string,width_in:variant,height_in:variant,glass:string,u_factor:variant,egress:string,"
          "clear_opening_sqft:variant>")
_EVIDENCE = "struct<page:int,region:string,bbox:array<double>>"
_ITEM = (f"struct<unit_id:string,kind:variant,panels:array<{_PANEL}>,qty:variant,source_marks:array<string>,"
         "color_interior:string,color_exterior:string,rough_opening:variant,evidence:variant,"
         "confidence:variant,flags:array<string>,discovery_gaps:array<string>>")
_WRAPPED = f"struct<units:array<{_ITEM}>,data:array<{_ITEM}>>"


def response_items(parsed: Column) -> Column:
    """The list of unit objects in any accepted wrapping, with their fields as they were given; NULL for what is not an object."""
    filled = lambda a: F.when(F.size(a) > 0, a)
    unwrapped = bind(_read(parsed, _WRAPPED), lambda o: F.when(
        o.isNotNull(), F.coalesce(filled(o["units"]), filled(o["data"]), F.array(_read(parsed, _ITEM)))))
    return F.coalesce(_read(parsed, f"array<{_ITEM}>"), unwrapped)


def measure(v: Column) -> Column:
    """Number, or text holding a measurement, as double.

    A number is read as it is; its text would be read as the same double, at several times the cost.
    """
    return F.when(F.schema_of_variant(v) == "STRING", inches_value(_read(v, "string"))).otherwise(_read(v, "double"))


def truth_value(text: Column) -> Column:
    """Boolean, number or a yes/no word; other text is NULL rather than true."""
    word = F.lower(text)
    return (F.when(one_of(word, ("true", "yes", "y", "1")), True)
            .when(one_of(word, ("false", "no", "n", "0")), False))


def _panel(p: Column) -> Column:
    """Typed panel and ``bad``: a size is unreadable or a given number is not one."""
    bad = lambda given, number: given.isNotNull() & ~F.is_variant_null(given) & number.isNull()
    values = F.struct(
        F.coalesce(p["role"], F.lit(DEFAULT_KIND)).alias("role"),
        measure(p["width_in"]).alias("width_in"), measure(p["height_in"]).alias("height_in"),
        p["glass"].alias("glass"), _read(p["u_factor"], "double").alias("u_factor"),
        truth_value(p["egress"]).alias("egress"),
        _read(p["clear_opening_sqft"], "double").alias("clear_opening_sqft"))
    return bind(values, lambda v: F.struct(v.alias("panel"), (
        v["width_in"].isNull() | v["height_in"].isNull() | bad(p["u_factor"], v["u_factor"])
        | bad(p["clear_opening_sqft"], v["clear_opening_sqft"])).alias("bad")))


def _evidence(e: Column) -> Column:
    b = lambda boxes: F.when(F.size(boxes) == 4, box(boxes[0], boxes[1], boxes[2], boxes[3]))
    zero = F.array(*[F.lit(0.0)] * 4)
    return F.struct(
        F.coalesce(e["page"], F.lit(0)).alias("page"),
        F.coalesce(e["region"], F.lit(DEFAULT_REGION)).alias("region"),
        bind(F.coalesce(e["bbox"], zero), b).alias("bbox"))


def _listed(item: Column, name: str, kind: str) -> Column:
    return F.coalesce(item[name], F.array().cast(f"array<{kind}>"))


def item_values(item: Column) -> Column:
    """Typed panels, quantity, confidence and rough opening of a response item: what decides whether it can be used."""
    ro_given = F.coalesce(F.size(_read(item["rough_opening"], "map<string,variant>")) > 0, F.lit(False))
    opening = lambda o: F.struct(measure(o["w_in"]).alias("w_in"), measure(o["h_in"]).alias("h_in"))
    ro = F.when(ro_given, bind(_read(item["rough_opening"], _RO), opening))
    qty = F.when(item["qty"].isNull(), F.lit(DEFAULT_QTY)).otherwise(_read(item["qty"], "int"))
    confidence = F.when(item["confidence"].isNull(),
                        F.lit(DEFAULT_CONFIDENCE)).otherwise(_read(item["confidence"], "double"))
    return F.struct(F.transform(_listed(item, "panels", _PANEL), _panel).alias("read"), qty.alias("qty"),
                    confidence.alias("confidence"), ro.alias("ro"))


def unit_fields(item: Column, values: Column, position: Column) -> dict[str, Column]:
    """Fields of the unit of a response item and its ``item_values``, with ``reject``: why it cannot be used, or NULL."""
    read, qty, confidence, ro = (values[n] for n in ("read", "qty", "confidence", "ro"))
    evidence = F.coalesce(_read(item["evidence"], f"array<{_EVIDENCE}>"), F.array().cast(f"array<{_EVIDENCE}>"))
    missing = lambda c: c.isNull() | F.coalesce(F.is_variant_null(c), F.lit(False))
    reject = (F.when(item.isNull(), "not an object")
              .when(F.size(read) == 0, "no panels")
              .when(F.array_contains(read["bad"], True), "unreadable panel")
              .when(qty.isNull(), "unreadable qty")
              .when(confidence.isNull(), "unreadable confidence")
              .when(ro.isNotNull() & (ro["w_in"].isNull() | ro["h_in"].isNull()), "unreadable rough opening"))
    return {
        "unit_id": F.coalesce(F.nullif(item["unit_id"], F.lit("")), F.concat(F.lit("G"), (position + 1).cast("string"))),
        "kind": F.when(missing(item["kind"]), F.lit(DEFAULT_KIND)).otherwise(_read(item["kind"], "string")),
        "panels": read["panel"], "qty": qty, "source_marks": _listed(item, "source_marks", "string"),
        "color_interior": item["color_interior"], "color_exterior": item["color_exterior"], "rough_opening": ro,
        "evidence": F.transform(F.filter(evidence, lambda e: e.isNotNull()), _evidence), "confidence": confidence,
        "flags": _listed(item, "flags", "string"), "discovery_gaps": _listed(item, "discovery_gaps", "string"), "reject": reject}
