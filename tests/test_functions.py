"""Literal cases of the column functions."""

import math
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from fenestra.functions import cells, codes, geometry as ge, inches, text as tx
from fenestra.operators.discovery import ro_to_frame, to_offer_form


def one(spark, column, **values):
    """Value of ``column`` on one row of string or number literals."""
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("v")).first().v


def many(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.o for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def test_inches(spark):
    cases = {"72": 72.0, "72.5": 72.5, "36.1875": 36.1875, "72 1/2": 72.5, "36 3/16": 36.1875, "48 3/16": 48.1875,
             "1/2": 0.5, '88 1/2"': 88.5, "12''": 12.0, " 5 ": 5.0, "-3": -3.0, "36 3/16": 36.1875,
             "": None, "x": None, "1/0": None, "1 2 3": None}
    assert many(spark, inches.inches_value, list(cases)) == list(cases.values())
    errors = many(spark, lambda c: inches.parse_inches(c)["error"], ["72", "", "x", "1/0", None])
    assert errors[0] is None and errors[1] == "empty" and all(errors[1:])


def test_rounding_is_half_even(spark):
    rounded = many(spark, lambda c: inches.round_dim(c.cast("double")), ["48.1875", "48.4", "36.25", "72.75"])
    assert rounded == [48.0, 48.5, 36.0, 73.0]
    assert many(spark, lambda c: inches.ufactor_bucket(c.cast("double")), ["0.234", "0.235", "-0.001", None]) == [
        "0.23", "0.23", "0.00", None]


def test_codes_and_literals(spark):
    sizes = {"2870": (32, 84, 1), "3050": (36, 60, 1), "2856": (32, 66, 1), "3180": (37, 96, 1), "2-2870": (64, 84, 2),
             "3 - 2870": (96, 84, 3), "2'-8\" x 7'-0\"": (32, 84, 1), "3'-1\" x 8'-0\"": (37, 96, 1), "32 x 84": (32, 84, 1),
             "2'-8\" x 5'-6 1/2\"": (32, 66.5, 1)}
    out = many(spark, lambda c: codes.decode(c, F.lit("weather_shield")), list(sizes))
    assert [(o.width_in, o.height_in, o.mull_count) for o in out] == list(sizes.values())
    bad = many(spark, lambda c: codes.decode(c, F.lit("weather_shield")), ["287", "n/a", "1/0 x 3"])
    assert all(b.error and b.width_in is None for b in bad)
    unknown = many(spark, lambda c: codes.decode(c, F.lit("other")), ["2870", "32 x 84"])
    assert unknown[0].error == "unknown notation profile" and unknown[1].width_in == 32


def test_rough_opening_to_frame(spark):
    frame = lambda w, h, kind, shim=None: tuple(one(spark, ro_to_frame(F.col("w"), F.col("h"), F.col("k"), shim), w=w, h=h, k=kind))
    assert frame(73.25, 89.25, "window") == (72.5, 88.5)
    assert frame(36.75, 80.5, "door") == (36.0, 80.0)
    assert frame(36.75, 48.75, "composite") == (36.0, 48.0)
    assert frame(48.5, 60.5, "door", 0.5) == (47.5, 59.5)
    units = spark.createDataFrame(
        [("window", [("window", 1.0, 2.0), ("door", 3.0, 4.0)], (73.25, 89.25)), ("window", [("window", 1.0, 2.0)], None)],
        "kind string, panels array<struct<role string, width_in double, height_in double>>, "
        "rough_opening struct<w_in double, h_in double>")
    first, second = [[(p.width_in, p.height_in) for p in r.panels] for r in to_offer_form(units).collect()]
    assert first == [(72.5, 88.5), (3.0, 4.0)] and second == [(1.0, 2.0)]


def test_tiles_and_boxes(spark):
    size = lambda tile, overlap, w=10800, h=7200: one(spark, F.size(ge.tiles(F.lit(w), F.lit(h), tile, overlap)))
    assert size(1024, .18) == 117 and size(2048, 0.0) == 24
    small = one(spark, ge.tiles(F.lit(500), F.lit(400), 1024, .18))
    assert [(t.x, t.y, t.w) for t in small] == [(0, 0, 1024)] * 4
    b = lambda *v: ge.box(*[F.lit(float(x)) for x in v])
    assert one(spark, ge.iou(b(0, 0, 10, 10), b(0, 0, 10, 10))) == 1.0
    assert math.isclose(one(spark, ge.iou(b(0, 0, 10, 10), b(5, 0, 10, 10))), 1 / 3)
    assert one(spark, ge.iou(b(0, 0, 0, 0), b(0, 0, 0, 0))) == 0.0
    assert tuple(one(spark, ge.percent_box(F.array(*[F.lit(x) for x in (.1, .2, .5, .333)]), F.lit(1000), F.lit(99)))) == (100, 19, 500, 32)
    assert tuple(one(spark, ge.percent_box(F.lit(None).cast("array<double>"), F.lit(1000), F.lit(99)))) == (0, 0, 1000, 99)
    assert one(spark, ge.clear_opening_sqft(F.lit(72.0), F.lit(24.0))) == 12.0


def test_evidence_always_takes_the_true_page(spark):
    ev = lambda page: F.array(F.struct(F.lit(page).alias("page"), F.lit("plan").alias("region"),
                                       ge.box(*[F.lit(float(v)) for v in (1, 2, 3, 4)]).alias("bbox")))
    moved = one(spark, ge.reanchor(ev(0), F.lit(7), F.lit(10.0), F.lit(20.0)))[0]
    assert (moved.page, tuple(moved.bbox)) == (7, (11.0, 22.0, 3.0, 4.0))
    assert one(spark, ge.reanchor(ev(3), F.lit(7), F.lit(0.0), F.lit(0.0)))[0].page == 7


def test_text_predicates(spark):
    assert many(spark, tx.has_unit_table, ["Window  schedule", "Rough opening / mark", "rough opening", "plan"]) == [
        True, True, False, False]
    assert many(spark, tx.detect_profile, ["by Weather\nShield Inc", "weather"]) == ["weather_shield", None]
    assert many(spark, tx.glass_kind, ["TEMP x ANN", "TEMP", "ANN", "TEMPERED"]) == ["mixed", "tempered", "annealed", "unknown"]
    count = one(spark, tx.elevation_counts(F.col("t")), t="First Level, first level; T.O. Parapet elevation")
    assert (count.level_hits, count.score) == (2, 2 + 2 + 20)


def test_identifiers_and_cells(spark):
    assert one(spark, tx.safe_id(F.lit("a:b/c d+1"))) == "a_b_c_d+1"
    assert one(spark, tx.model_slug(F.lit("brand/x:1"))) == "brand_x_1"
    assert one(spark, tx.provider_name(F.lit("azure:gpt:4"))) == "azure"
    assert one(spark, tx.provider_model(F.lit("azure:gpt:4"))) == "gpt:4"
    assert one(spark, tx.provider_model(F.lit("mock"), F.lit("none"))) == "none"
    cells_ = spark.sql("select map('QTY.', '1', 'Day open (SF)', '2', 'Qty', '3') m").select(tx.canonical_cells(F.col("m")))
    assert cells_.first()[0] == {"DAYOPEN": "2", "QTY": "3"}
    exact = spark.sql("select map('QTY', '1', 'QTY.', '2', 'Qty', '3') m").select(tx.canonical_cells(F.col("m")))
    assert exact.first()[0] == {"QTY": "1"}
    marks = spark.sql("select explode(array(map('#', ' a '), map('MARK', 'b'), map('x', 'c'))) m").select(tx.mark_key(F.col("m")))
    assert [r[0] for r in marks.collect()] == ["A", "B", None]


def test_display_numbers(spark):
    assert many(spark, tx.format_number_cell, ["0.0725", "2", "", "None", "nan", "x", None]) == [
        "0.072", "2.000", "—", "—", "—", "x", "—"]
    assert many(spark, tx.format_dollar_cell, ["1234.5678"]) == ["$1234.568"]
    assert many(spark, tx.format_percent_cell, ["0.5"]) == ["50.0%"]


def test_table_cells(spark):
    assert many(spark, cells.cell_glass, ["Temp.", "ANN", "mixed", "clear"]) == ["tempered", "annealed", "mixed", None]
    assert many(spark, lambda c: cells.cell_egress(c, "v1"), ["Y", "no", "x", "-"]) == [True, False, None, None]
    assert many(spark, lambda c: cells.cell_egress(c, "v2"), ["Y", "no", "x", "-"]) == [True, False, True, False]
    assert many(spark, cells.cell_ufactor, ["0.24 max", "n/a", None]) == [0.24, None, None]
    assert many(spark, cells.cell_qty, [" 3 ", "x", None]) == [3, 1, 1]
    assert many(spark, cells.mark_kind, ["d1", "W1"]) == ["door", "window"]


@pytest.mark.parametrize("vocab,first,expected", [("v1", ["foo", "Mark"], True), ("v2", ["foo", "Mark"], False),
                                                  ("v2", ["Qty", "Mark"], True)])
def test_header_detection(spark, vocab, first, expected):
    heads = F.array(*[cells.heading(F.lit(h)) for h in first])
    assert one(spark, cells.is_schedule_header(heads, vocab)) is expected


def test_offer_numbers(spark):
    assert many(spark, inches.mixed_fraction, ["36 3/16", '72"', "1 1/0", "x"]) == [36.1875, 72.0, None, None]
    assert many(spark, tx.money, ["1,234.50", "", "x"])[0] == Decimal("1234.50")
    pair = many(spark, tx.dimension_pair, ['72 1/2" x 88 1/2', "no"])
    assert tuple(pair[0]) == (72.5, 88.5) and tuple(pair[1]) == (None, None)
    assert one(spark, tx.clip_text(F.lit("abcdef"), 3)) == "abc"
