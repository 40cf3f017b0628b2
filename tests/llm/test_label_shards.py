import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from fenestra.llm import label_shards as b
from fenestra.llm.queries import all_queries


def check(rows, texts, shards):
    counts = Counter(r.shard for r in rows)
    n = len(texts)
    assert len(rows) == n and all(counts[i] in (n // shards, -(-n // shards)) for i in range(shards))
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    want = Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in texts)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want


def cuts(rows):
    held = defaultdict(list)
    for r in rows:
        held[r.link].append(r.shard)
    return sum(len(set(v)) - 1 for v in held.values()), [v for v in held.values() if len(v) > 1]


def test_query(spark, sf):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = all_queries()["op10_label_shards"](spark, sf).collect()
    check(rows, texts, 24)
    assert {(r.law, r.grown_shard) for r in rows} == {("rows", None)}


def test_groups_stay_together(spark):
    texts = [(i, f"text {i % 400}" if i < 1_600 else f"own {i}") for i in range(6_000)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    rows = b.shard(docs, 8).collect()
    check(rows, texts, 8)
    cut, groups = cuts(rows)
    assert len(groups) == 400 and cut <= 20  # without moves, four rows touch 3.3 of 8 shards: about 900 cuts


def test_a_group_with_a_third_of_all_rows(spark):
    texts = [(i, "hot" if i % 3 == 0 else f"own {i // 2}") for i in range(6_000)]
    rows = b.shard(spark.createDataFrame(texts, "doc_id bigint, text string"), 24).collect()
    check(rows, texts, 24)
    hot = Counter(r.shard for r in rows if r["size"] == 11)
    assert len(hot) <= 12  # 2,000 rows need 8 shards of 250


def test_all_rows_linked(spark):
    texts = [(i, f"text {i % 10}") for i in range(1_001)]
    rows = b.shard(spark.createDataFrame(texts, "doc_id bigint, text string"), 7).collect()
    check(rows, texts, 7)


def test_awkward_documents(spark, awkward, no_documents):
    rows = b.shard(awkward, 3).collect()
    check(rows, [(r.doc_id, r.text) for r in awkward.collect()], 3)
    assert b.shard(no_documents, 3).count() == 0
    assert b.shard(awkward.limit(1), 24).count() == 1


def test_other_links(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"), (F.col("id") % 30).alias("thread"))
    rows = b.shard(docs, 3, link=F.col("thread").cast("string")).collect()
    cut, groups = cuts(rows)
    assert len(groups) == 30 and cut <= 12


def test_no_python_in_the_plan(spark, sf):
    plan = all_queries()["op10_label_shards"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
