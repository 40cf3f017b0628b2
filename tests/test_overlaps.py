"""Overlap merging against a plain ordered walk."""

import random

import pytest
from pyspark.sql import functions as F

from fenestra.operators import overlaps

UNIT = ("doc string, n int, kind string, panels array<struct<role string, width_in double, height_in double, glass string, "
        "u_factor double, egress boolean>>, qty int, confidence double, evidence array<struct<page int, region string, "
        "bbox struct<x double, y double, w double, h double>>>")


def unit(doc, n, boxes, qty=1, confidence=.5, glass=None):
    return (doc, n, "window", [("window", 30.0, 40.0, glass, None, None)], qty, confidence,
            [(page, "plan", tuple(map(float, b))) for page, b in boxes])


def overlap(a, b):
    iw = max(0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]))
    ih = max(0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))
    union = a[2] * a[3] + b[2] * b[3] - iw * ih
    return iw * ih / union if union > 0 else 0


def walk(rows):
    """{(doc, n): (qty, confidence)} of the units that stay."""
    kept = []
    for row in sorted(rows, key=lambda r: r[1]):
        key = (row[0], row[3][0][3])
        for k in kept:
            if k["key"] == key and any(p == q and overlap(a, b) > .4 for p, _, a in row[6] for q, _, b in k["boxes"]):
                if row[5] > k["confidence"]:
                    k["confidence"], k["qty"] = row[5], max(k["qty"], row[4])
                break
        else:
            kept.append({"key": key, "id": row[:2], "boxes": row[6], "qty": row[4], "confidence": row[5]})
    return {k["id"]: (k["qty"], k["confidence"]) for k in kept}


def result(spark, rows, **options):
    out = overlaps.dedup_overlaps(spark.createDataFrame(rows, UNIT), ["doc"], ["n"], **options)
    return {(r.doc, r.n): (r.qty, r.confidence) for r in out.collect()}


@pytest.mark.parametrize("max_local_rows", [2000, 0])
def test_equals_an_ordered_walk(spark, max_local_rows):
    rng = random.Random(3)
    rows = []
    for n in range(160 if max_local_rows else 90):
        spot = lambda: (rng.randrange(1, 3), (rng.randrange(0, 60), rng.randrange(0, 40), rng.choice((5, 12, 20, 44)), rng.choice((6, 15, 30))))
        boxes = [spot() for _ in range(rng.choice((0, 1, 1, 1, 2)))]
        rows.append(unit(f"d{n % 2}", n, boxes, rng.randrange(1, 9), rng.choice((.5, .6, .7, .9)), rng.choice((None, "mixed"))))
    rows += [unit("d0", 1000 + i, [(1, (3, 3, 20, 15))], i, .5 + i / 100) for i in range(12)]  # copies
    assert result(spark, rows, max_local_rows=max_local_rows) == walk(rows)


def test_pages_and_empty_boxes(spark):
    same = [unit("d", 1, [(1, (0, 0, 10, 10))]), unit("d", 2, [(2, (0, 0, 10, 10))])]
    assert len(result(spark, same)) == 2
    assert len(result(spark, same, page_scoped=False)) == 1
    flat = [unit("d", n, [(1, (0, 0, 0, 0))]) for n in range(3)]
    assert len(result(spark, flat)) == 3 and len(result(spark, flat, max_local_rows=0)) == 3


def test_chain_keeps_every_other_box(spark):
    rows = [unit("d", n, [(1, (n * 3, 0, 10, 10))]) for n in range(9)]
    for limit in (2000, 0):
        assert set(result(spark, rows, max_local_rows=limit)) == set(walk(rows))


def test_pairs_come_from_common_cells(spark):
    rng = random.Random(1)
    boxes = [(i, rng.random() * 50, rng.random() * 50, 1 + rng.random() * 40, 1 + rng.random() * 40) for i in range(60)]
    df = spark.createDataFrame(boxes, "id int, x double, y double, w double, h double").select(
        F.lit(1).alias("k"), "id", F.struct("x", "y", "w", "h").alias("b"))
    got = {(r.a_id, r.b_id) for r in overlaps.overlap_pairs(df, ["k"], "id", "b").collect()}
    assert got == {(a[0], b[0]) for a in boxes for b in boxes if a[0] < b[0] and overlap(a[1:], b[1:]) > .4}
