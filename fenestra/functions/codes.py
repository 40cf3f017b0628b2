"""Size notations: four-digit codes, literals and their dispatch by profile."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from fenestra.functions.binding import bind, to_number
from fenestra.functions.inches import inches_value, strip

# fixed values: accepted notations
_QUAD = r"(?U)^(?:(\d+)\s*-\s*)?(\d{4})$"
_FEET = (r"(?U)^\s*(\d+)\s*'\s*[- ]?\s*(\d+(?:\s+\d+/\d+)?)\s*\"?\s*[xX\u00d7]\s*"
         r"(\d+)\s*'\s*[- ]?\s*(\d+(?:\s+\d+/\d+)?)\s*\"?\s*$")
_PAIR = r"(?U)^\s*([\d /.]+?)\s*[xX\u00d7]\s*([\d /.]+?)\s*$"


def _none(kind: str) -> Column:
    return F.lit(None).cast(kind)


def _size(width: Column, height: Column, count: Column, single: Column, error: str) -> Column:
    """Decoded size; ``error`` is reported when the width or the height is missing."""
    ok = width.isNotNull() & height.isNotNull()
    return F.struct(F.when(ok, width).alias("width_in"), F.when(ok, height).alias("height_in"),
                    F.when(ok, count).alias("mull_count"), F.when(ok, single).alias("unit_width_in"),
                    F.when(~ok, F.lit(error)).alias("error"))


def decode_quad(code: Column) -> Column:
    """``2870`` -> 2'8" x 7'0"; ``N-2870`` is N units side by side."""
    def parts(text: Column) -> Column:
        count = F.coalesce(to_number(F.regexp_extract(text, _QUAD, 1), "int"), F.lit(1))
        return F.struct(F.regexp_extract(text, _QUAD, 2).alias("quad"), count.alias("n"))

    def sides(p: Column) -> Column:
        digit = lambda i: to_number(F.substring(p["quad"], i, 1))
        return F.struct((digit(1) * 12 + digit(2)).alias("w"), (digit(3) * 12 + digit(4)).alias("h"),
                        p["n"].alias("n"))

    return bind(F.upper(strip(code.cast("string"))), lambda text: bind(parts(text), lambda p: bind(
        sides(p), lambda s: _size(s["w"] * s["n"], s["h"], s["n"], s["w"],
                                  "not a four-digit code"))))


def decode_literal(text: Column) -> Column:
    """``2'-8" x 7'-0"`` or ``32 x 84``, fractions allowed."""
    def side(raw: Column, feet: int, inch: int, plain: int) -> Column:
        in_feet = (to_number(F.regexp_extract(raw, _FEET, feet)) * 12
                   + inches_value(F.regexp_extract(raw, _FEET, inch)))
        return F.coalesce(in_feet, inches_value(F.regexp_extract(raw, _PAIR, plain)))

    return bind(text.cast("string"), lambda raw: bind(
        F.struct(side(raw, 1, 2, 1).alias("w"), side(raw, 3, 4, 2).alias("h")),
        lambda s: _size(s["w"], s["h"], F.lit(1), _none("double"), "not a literal size")))


#: notation profile -> column function; extend to add a manufacturer.
PROFILES: dict[str, Callable[[Column], Column]] = {"weather_shield": decode_quad}


def decode(code: Column, profile: Column) -> Column:
    """Decode under a named profile; a literal carries its own units and always wins.

    An unknown profile is reported in ``error``, never guessed.
    """
    looks_literal = code.rlike(r"['\"]") | code.rlike(
        r"(?U)^\s*[\d /.]+\s*[xX\u00d7]\s*[\d /.]+\s*$")

    def by_profile() -> Column:
        out = F.when(F.lit(False), _size(_none("double"), _none("double"), _none("int"),
                                         _none("double"), ""))
        for name, fn in PROFILES.items():
            out = out.when(profile == name, fn(code))
        return out.otherwise(_size(_none("double"), _none("double"), _none("int"),
                                   _none("double"), "unknown notation profile"))

    return bind(F.when(looks_literal, decode_literal(code)), lambda literal: F.when(
        literal.isNotNull() & literal["error"].isNull(), literal).otherwise(by_profile()))
