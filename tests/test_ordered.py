"""Numbering and running totals with a group that has most of the rows."""

import random

from pyspark.sql import functions as F

from fenestra.operators import ordered
from fenestra.operators.leaderboard import within_budget
from fenestra.operators.ordered import row_numbers, running_totals, top_rows
from fenestra.operators.routing import sample_pages


def skewed(spark):
    rng = random.Random(2)
    rows = [(None if i % 11 == 0 else "hot" if i % 3 else f"k{i % 5}", i, rng.randrange(1, 100)) for i in range(400)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "k string, i int, v int")


def test_row_numbers_of_a_split_group(spark):
    df = skewed(spark)
    whole = row_numbers(df, ["k"], [F.col("i")], "n")
    split = row_numbers(df, ["k"], [F.col("i")], "n", max_group_rows=20)
    assert sorted(map(str, whole.collect())) == sorted(map(str, split.collect()))
    assert dict(whole.dtypes)["n"] == dict(split.dtypes)["n"] == "bigint"
    down = row_numbers(df, [], [F.col("i").desc()], "n", max_group_rows=20)
    assert down.where("n = 1").first().i == 399


def test_running_totals_of_a_split_group(spark):
    df = skewed(spark)
    total = lambda **o: {r.i: r.t for r in running_totals(
        df, ["k"], [F.col("i")], F.col("v").cast("decimal(18,2)"), "t", **o).collect()}
    assert total() == total(max_group_rows=20)


def test_budget(spark):
    df = spark.createDataFrame([(i, 2.5) for i in range(6)] + [(9, None)], "seq int, cost_usd double")
    for options in ({}, {"max_group_rows": 1}):
        runs = {r.seq: r.runs for r in within_budget(df, ["seq"], 5.0, **options).collect()}
        assert [s for s, r in sorted(runs.items()) if r] == [0, 1]
    assert within_budget(df, ["seq"], 0.0).where("not runs").count() == 0


def test_top_rows_limit_before_the_shuffle(spark, tmp_path):
    skewed(spark).write.parquet(str(tmp_path / "t"))
    top = top_rows(spark.read.parquet(str(tmp_path / "t")), ["k"], [F.col("v").desc(), F.col("i")], 2)
    assert top.groupBy("k").count().where("count > 2").isEmpty()
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()


def test_page_sample(spark):
    pages = spark.createDataFrame([("a", p) for p in range(1, 8)] + [("b", 1), ("c", 1), ("c", 2)], "doc_id string, page_no bigint")
    got = sorted((r.doc_id, r.page_no) for r in sample_pages(pages).collect())
    assert got == [("a", 1), ("a", 4), ("a", 7), ("b", 1), ("c", 1), ("c", 2)]
    assert sample_pages(pages, 2).where("doc_id = 'a'").count() == 2


def test_groups_are_counted_together_first(spark, monkeypatch):
    """Buckets say at once that no group is large; where one is too large, its groups are counted."""
    rows = spark.createDataFrame([(i % 10, None if i % 2 else i) for i in range(100)], "g int, h int")
    monkeypatch.setattr(ordered, "BUCKETS", 1)
    assert not ordered.has_large_group(rows, ["g"], 10)
    assert ordered.has_large_group(rows, ["g"], 9) and ordered.has_large_group(rows, ["h"], 49) and not ordered.has_large_group(rows, ["h"], 50)
    assert ordered.has_large_group(rows, [], 99) and not ordered.has_large_group(rows, [], 100)
