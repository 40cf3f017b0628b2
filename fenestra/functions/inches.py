"""Inch measurements: parsing, rounding and bucketing."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from fenestra.functions.binding import bind

# (?U) makes the blank and digit classes Unicode aware: text taken from documents often holds
# no-break spaces.
_DECIMAL = r"(?U)^\s*(-?\d+(?:\.\d+)?)\s*$"
_FRACTION = r"(?U)^\s*(?:(\d+)\s+)?(\d+)\s*/\s*(\d+)\s*$"


# fixed value: every character that counts as white space
_WHITE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
          "\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def strip(c: Column) -> Column:
    """Trim every kind of white space, not only the space character."""
    return F.btrim(c, F.lit(_WHITE))


def inches_value(c: Column) -> Column:
    """``'72'``, ``'72.5'``, ``'36 3/16'``, ``'1/2'``, with or without inch marks -> double.

    NULL when the text is not a measurement or the denominator is zero.
    """
    raw = c.cast("string")
    for mark in ('"', "''", "\u201d"):
        raw = F.replace(raw, F.lit(mark), F.lit(""))
    # the numbers of a fraction are all its digits: with a whole number in front they are three
    numbers = lambda r: F.when(r.rlike(_FRACTION), F.regexp_extract_all(r, F.lit(r"(?U)(\d+)"), F.lit(1)))
    part = lambda d, i: F.try_element_at(d, F.lit(i)).try_cast("double")
    fraction = lambda r: bind(numbers(r), lambda d: F.coalesce(part(d, -3), F.lit(0.0)) + F.try_divide(part(d, -2), part(d, -1)))
    return bind(raw, lambda r: F.when(F.contains(r, F.lit("/")), fraction(r)).when(
        r.rlike(_DECIMAL), strip(r).try_cast("double")))


def parse_inches(c: Column) -> Column:
    """``struct<value: double, error: string>``; exactly one side is set unless the input is NULL."""
    text = c.cast("string")
    error = lambda value: (F.when(text.isNull(), F.lit("not a measurement"))
                           .when(text.rlike(r"(?U)^\s*$"), F.lit("empty"))
                           .when(value.isNull(), F.concat(F.lit("unparseable: "), text)))
    return bind(inches_value(c), lambda v: F.struct(v.alias("value"), error(v).alias("error")))


def mixed_fraction(c: Column) -> Column:
    """Sum of the blank-separated parts of ``'36 3/16'``; used on offer forms."""
    parts = F.filter(F.split(F.replace(c, F.lit('"'), F.lit("")), r"(?U)\s+"), lambda p: p != "")
    value = lambda p: F.when(p.contains("/"), F.try_divide(
        F.split_part(p, F.lit("/"), F.lit(1)).try_cast("double"),
        F.split_part(p, F.lit("/"), F.lit(2)).try_cast("double"))).otherwise(p.try_cast("double"))
    return F.aggregate(F.transform(parts, value), F.lit(0.0), lambda acc, x: acc + x)


def round_steps(v: Column, bucket: float = 0.5) -> Column:
    """Number of buckets nearest to ``v`` (ties to even) as bigint."""
    return F.rint(v / F.lit(float(bucket))).cast("bigint")


def round_dim(v: Column, bucket: float = 0.5) -> Column:
    """``v`` rounded to the bucket, ties to even."""
    return F.rint(v / F.lit(float(bucket))) * F.lit(float(bucket))


def ufactor_bucket(u: Column, step: float = 0.01) -> Column:
    """U-factor as a two-decimal bucket label; NULL stays NULL."""
    bucket = F.rint(u / F.lit(float(step))) * F.lit(float(step)) + F.lit(0.0)
    return F.when(u.isNotNull(), F.call_function("format_number", bucket, F.lit("0.00")))
