import hashlib
import math

import pytest
from pyspark.sql import functions as F

from fenestra.llm import poisson_mix as m
from fenestra.llm.queries import all_queries


def draw(rate, doc_id, seed=m.SEED):
    u = int(hashlib.md5(f"count:{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:13], 16) / 2 ** 52
    k, p, c = 0, math.exp(-rate), math.exp(-rate)
    assert p > 0
    while c <= u:
        k += 1
        p *= rate / k
        c += p
    return k


def test_counts_are_inverted_draws(spark, awkward, no_documents):
    rows = m.mix(awkward, temperature=0.9, total=3.0).collect()
    rates = {r.source: r.rate for r in m.source_rates(awkward, temperature=0.9, total=3.0).collect()}
    for d in {r.doc_id for r in awkward.collect()}:
        source = [r.source for r in awkward.collect() if r.doc_id == d]
        got = sorted(r["copy"] for r in rows if r.doc_id == d)
        assert got == sorted(k for s in source for k in range(draw(rates[s], d)))
    assert m.mix(no_documents).count() == 0


def test_targets_are_met_on_average(spark):
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "rare").otherwise("hot").alias("source"),
                                      F.lit("ten chars.").alias("text"), F.lit(1).alias("rate"))
    got = {r.source: r["count"] for r in m.mix(docs, {"rare": 3.0, "hot": 1.0}).groupBy("source").count().collect()}
    assert abs(got["rare"] - 22_500) < 600 and abs(got["hot"] - 7_500) < 350
    only = m.mix(docs, {"rare": 1.0}).groupBy("source").count().collect()
    assert [r.source for r in only] == ["rare"]


@pytest.mark.parametrize("rate", [0.0, 1e-6, 0.5, 3.0, 900.0])
def test_distribution(spark, rate):
    rates = spark.createDataFrame([("s", 1, rate)], "source string, volume bigint, rate double")
    cdf = m.with_distribution(rates).first().cdf
    total = 0.0
    for k, c in enumerate(cdf):
        total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1)) if rate else float(k == 0)
        assert abs(c - total) < 1e-9
    assert abs(cdf[-1] - 1) < 1e-9


def test_order_is_global_and_repeatable(spark, sf):
    query = all_queries()["op9_poisson_mix"]
    rows = [(r.order_key, r.doc_id) for r in query(spark, sf).collect()]
    assert rows == sorted(rows) and rows == [(r.order_key, r.doc_id) for r in query(spark, sf).collect()]
    ids = [d for _, d in rows]
    n = len(ids)
    # neighbours in the order are not neighbours by id
    assert sum(abs(a - b) <= 1 for a, b in zip(ids, ids[1:])) < 0.1 * n


def test_no_python_in_the_plan(spark, sf):
    plan = all_queries()["op9_poisson_mix"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
