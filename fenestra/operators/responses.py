"""Model responses -> units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fenestra.functions.geometry import reanchor
from fenestra.functions.model_json import find_json, find_json_greedy, item_values, response_items, unit_fields


def _items(responses: DataFrame, text: str) -> tuple[DataFrame, dict[str, Column]]:
    """One row per response item, with ``item_no``, and the fields of its unit over that row.

    What a field is made from is generated, so it is made once however many fields and conditions use it.
    """
    parsed = responses.withColumn("_json", find_json(F.col(text)))
    items = parsed.select(*responses.columns, F.posexplode(response_items(F.col("_json"))).alias("item_no", "_given"))
    typed = items.select("*", F.explode(F.array(item_values(F.col("_given")))).alias("_values"))
    return typed, unit_fields(F.col("_given"), F.col("_values"), F.col("item_no"))


def parse_responses(responses: DataFrame, text: str = "raw_text") -> DataFrame:
    """One row per response item, with ``item_no`` and a ``unit`` struct.

    Rows whose ``unit.reject`` is set are kept so that nothing is dropped in
    silence; ``accepted`` and ``rejected`` split them.
    """
    items, fields = _items(responses, text)
    return items.select(*responses.columns, "item_no", F.struct(*[c.alias(n) for n, c in fields.items()]).alias("unit"))


def read_units(responses: DataFrame, text: str = "raw_text") -> DataFrame:
    """The same as ``accepted(parse_responses(responses, text))`` without the text, as columns of their own from the start: Spark
    leaves out those that the plan above does not use, which it cannot do inside a struct."""
    items, fields = _items(responses, text)
    reject = fields.pop("reject")
    keep = [c for c in responses.columns if c != text]
    return items.where(reject.isNull()).select(*keep, "item_no", *[c.alias(n) for n, c in fields.items()])


def accepted(parsed: DataFrame) -> DataFrame:
    """Flatten usable items to unit columns."""
    keep = [c for c in parsed.columns if c != "unit"]
    return parsed.where(F.col("unit.reject").isNull()).select(*keep, "unit.*").drop("reject")


def rejected(parsed: DataFrame) -> DataFrame:
    """Items that could not be used, with the reason."""
    keep = [c for c in parsed.columns if c != "unit"]
    return parsed.where(F.col("unit.reject").isNotNull()).select(
        *keep, F.col("unit.unit_id"), F.col("unit.reject"))


def anchor_units(units: DataFrame, page_no: str = "page_no", x: Column | None = None,
                 y: Column | None = None) -> DataFrame:
    """Evidence of cropped responses in page coordinates, with the true page."""
    zero = F.lit(0.0)
    return units.withColumn("evidence", reanchor(
        F.col("evidence"), F.col(page_no), zero if x is None else x, zero if y is None else y))


def page_reads(responses: DataFrame, text: str = "raw_text") -> DataFrame:
    """Single-object page reads: units array, confidence and readability per page.

    A page whose answer holds no object counts as unreadable with low
    confidence and no units, and stays in the result.
    """
    read = responses.withColumn("_json", find_json_greedy(F.col(text)))
    get = lambda name, kind: F.try_variant_get(F.col("_json"), f"$.{name}", kind)
    return read.select(
        *responses.columns,
        F.coalesce(get("confidence", "string"), F.lit("low")).alias("confidence"),
        F.coalesce(get("readable", "boolean"), F.lit(False)).alias("readable"),
        F.coalesce(get("units", "array<struct<mark:string,width_in:double,height_in:double,"
                       "qty:int,note:string>>"), F.array().cast(
            "array<struct<mark:string,width_in:double,height_in:double,qty:int,note:string>>"))
        .alias("units"))


def price_responses(responses: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost from token counts; NULL (not 0) for a model without a price.

    ``prices`` holds model, usd_in, usd_out per million tokens; its size decides
    the join strategy.
    """
    cost = F.col("in_tok") / F.lit(1e6) * F.col("usd_in") + F.col("out_tok") / F.lit(1e6) * F.col("usd_out")
    return (responses.join(prices, "model", "left").withColumn("cost_usd", cost)
            .drop("usd_in", "usd_out"))
