"""Small scopes are worked on where one shuffle puts them; the results are those of the general way."""

import random

import pytest
from pyspark.sql import functions as F

from fenestra.operators import comparison, schedules
from fenestra.operators.consensus import SOURCES, consensus, with_unit_ids
from fenestra.operators.matching import match_units
from fenestra.operators.overlaps import dedup_overlaps

PANEL = "role string, width_in double, height_in double, glass string, u_factor double, egress boolean, clear_opening_sqft double"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return plan(df).count("Exchange ")


def result(df):
    names = sorted(df.columns)
    return sorted(df.select(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("row")).toPandas()["row"])


def units(spark, seed, n=400):
    r = random.Random(seed)
    side = lambda: r.choice([None, 30.0, 30.5, 31.0, 31.5, 32.0])
    panels = lambda: [(r.choice(["window", "door", None]), side(), side(), r.choice(["a", None]), 0.24, None, None) for _ in range(r.choice([1, 1, 1, 2]))]
    rows = [(r.choice([None, *range(12)]), r.choice(["window", "composite"]), r.choice([panels(), panels(), panels(), None, []]), r.choice([1, 2, None])) for _ in range(n)]
    return spark.createDataFrame(rows, f"project int, kind string, panels array<struct<{PANEL}>>, qty int")


@pytest.mark.parametrize("tau", [0.0, 1.0, 2.0])
def test_match_of_small_scopes(spark, tau):
    pred, true = units(spark, 1), units(spark, 2)
    bound = pred.unionByName(true).select("project")
    match = lambda **more: match_units(pred, true, ["project"], tau_in=tau, **more)
    found = match(bound_by=bound, max_local_edges=10_000)
    assert exchanges(found) == 1
    assert result(found) == result(match())
    # some of the scopes are too large
    assert result(match(bound_by=bound, max_local_edges=64 * 64)) == result(match())


def test_dedup_of_small_scopes(spark):
    r = random.Random(3)
    box = lambda: (r.choice([1, 2, None]), "plan", r.choice([None, (float(r.randrange(30)), float(r.randrange(30)), 20.0, r.choice([0.0, 20.0]))]))
    rows = [(r.choice([None, 1, 2, 3]), r.randrange(40), r.choice(["window", "door"]), [("window", 30.0, 60.0, None, None, None, None)],
             r.choice([0.5, 0.7, None, 0.9, float("nan")]), r.choice([1, 2, 3, None]), [box() for _ in range(r.choice([0, 1, 1, 2]))]) for _ in range(300)]
    d = spark.createDataFrame(rows, f"doc int, item int, kind string, panels array<struct<{PANEL}>>, confidence double, qty int, "
                              "evidence array<struct<page:int,region:string,bbox:struct<x:double,y:double,w:double,h:double>>>")
    dedup = lambda **more: dedup_overlaps(d, ["doc"], ["item"], **more)
    kept = dedup(bound_by=d)
    assert exchanges(kept) == 1
    assert result(kept) == result(dedup())
    assert result(dedup(bound_by=d, max_local_rows=72)) == result(dedup())


def test_consensus_of_small_scopes(spark):
    d = units(spark, 4).withColumns({
        "source": F.element_at(F.array(*[F.lit(s) for s in SOURCES]), (1 + F.monotonically_increasing_id() % 4).cast("int")),
        "line": F.monotonically_increasing_id(), "source_marks": F.array(F.when(F.col("qty") == 1, F.lit("m")).otherwise(F.lit(""))),
        "sill_height_in": F.lit(None).cast("double")}).localCheckpoint()
    ids = lambda **more: with_unit_ids(consensus(d, ["project"], ["line"], **more), ["project"], **more)
    found = ids(bound_by=d)
    assert exchanges(found) == 1
    assert result(found) == result(ids())
    assert result(ids(bound_by=d, max_scope_rows=5)) == result(ids())


def test_tables_of_short_documents(spark):
    r = random.Random(5)
    heads = ["Size", " Mark ", "Glass", "mark", "Width", "Height", None, "other"]
    rows = []
    for doc, page in [(d, p) for d in (None, *range(12)) for p in (1, 2)]:
        for row in range(r.choice([0, 1]), 6):
            for col in range(6):
                text = r.choice(heads) if row == 0 else r.choice([" 30 X 60 ", "W1", "", None, "30 1/2", "x"])
                rows.append((doc, page, 0, row, col, text))
                if row == 0 and col == 3:
                    rows.append((doc, page, 0, 0, 3, "Size"))
    cells = spark.createDataFrame(rows, "doc_id int, page_no int, table_no int, row_no bigint, col_no int, text string")
    for vocab in ("v1", "v2"):
        for read in (schedules.table_units, schedules.table_rejects):
            here = read(cells, vocab, bound_by=cells)
            assert exchanges(here) == 1
            # maps have no order
            shown = lambda df: df.withColumn("cells", F.array_sort(F.map_entries("cells"))) if "cells" in df.columns else df
            assert result(shown(here)) == result(shown(read(cells, vocab, max_document_rows=1)))


def test_transcripts_are_dealt_out_before_they_are_sorted(spark):
    rows = spark.range(20).select(F.create_map(F.lit("#"), F.concat(F.lit("k"), F.col("id") % 7)).alias("cells"), F.col("id").alias("row_no"))
    marks = comparison.index_by_mark(rows, ["row_no"])
    assert "Sort" not in plan(marks).rpartition("Exchange ")[2]
    assert marks.count() == 7
