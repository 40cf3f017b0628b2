"""Name an intermediate value inside one column expression."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once however often ``body`` uses it.

    Nested regex expressions otherwise repeat their inputs until the generated
    method is too large to compile.
    """
    return F.transform(F.array(value), body)[0]


def to_number(text: Column, kind: str = "double") -> Column:
    """Cast that skips empty text: a regex group that did not take part is empty,
    and a failing cast costs far more than this test."""
    return bind(text, lambda t: F.when(t != "", t.try_cast(kind)))


def one_of(value: Column, words: tuple[str, ...]) -> Column:
    """``isin`` for lambdas: there each hit of ``isin`` throws, which costs far more than comparing."""
    return reduce(lambda a, b: a | b, [value == F.lit(w) for w in words])
