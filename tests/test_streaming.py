"""Commits, merged tables, indexed sinks, chat messages and the status table."""

import random

import pytest
from pyspark.sql import functions as F

from fenestra.streaming import commits, ingest, merged, runs

ROWS = "k string, t int, x int"


def test_tables_of_a_batch_appear_together(spark, tmp_path):
    root = str(tmp_path / "run")
    rows = spark.createDataFrame([("d", 1, '[{"unit_id":"W1","panels":[{"width_in":30,"height_in":40}],"qty":2}]', None),
                                  ("d", 2, "no json", None), ("d", 3, None, "timeout")],
                                 "doc_id string, page_no int, raw_text string, error string")
    write = runs.record_run(root)
    assert runs.run_table(spark, root, "log") is None

    def lost(batch):
        return {**runs.run_tables(batch), "raw": batch.select(F.raise_error(F.lit("lost")).cast("string").alias("x"))}

    with pytest.raises(Exception, match="lost"):
        commits.write_together(root, lost)(rows, 0)
    assert runs.run_table(spark, root, "units") is None and (tmp_path / "run" / "units").exists()
    for batch_id in (0, 0, 1):
        write(rows.where(f"page_no % 2 = {1 - batch_id}"), batch_id)
    assert sorted((r.page_no, r.error, r.raw_len) for r in runs.run_table(spark, root, "log").collect()) == [
        (1, None, 68), (2, None, 7), (3, "timeout", 0)]
    assert [r.page_no for r in runs.run_table(spark, root, "raw").orderBy("page_no").collect()] == [1, 2]
    units = runs.run_table(spark, root, "units").collect()
    assert [(u.page_no, u.unit_id, u.qty) for u in units] == [(1, "W1", 2)]
    assert len(list((tmp_path / "run" / "units").iterdir())) == 2  # the lost attempt is gone


def written(root, spark):
    return commits.latest(spark, root)["bytes_written"]


def test_merge_equals_the_newest_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(merged, "MOST_FILES", 2)
    monkeypatch.setattr(merged, "BUCKET_BYTES", 2_000)  # the buckets double several times
    root, rng, newest = str(tmp_path / "m"), random.Random(4), {}
    merge = merged.merge_batch(root, ["t"], ["k"], buckets=2)
    assert merged.read_current(spark, root) is None
    for batch_id in range(9):
        n = 200 if batch_id in (0, 5) else 6
        rows = [(None if i == 7 else f"k{rng.randrange(300)}", batch_id * 1000 + rng.randrange(-1500, 1000), i) for i in range(n)]
        rows = list({(k, t): (k, t, x) for k, t, x in rows}.values())
        for k, t, x in rows:
            if k not in newest or (t, ) > newest[k][:1]:
                newest[k] = (t, x)
        frame = spark.createDataFrame(rows, ROWS)
        merge(frame, batch_id)
        merge(frame.withColumn("x", F.lit(-1)), batch_id)  # the same batch once more does nothing
        assert {r.k: r.t for r in merged.read_current(spark, root).collect()} == {k: v[0] for k, v in newest.items()}
    now = commits.latest(spark, root)
    assert now["buckets"] > 2 and all(len([f for f in own if not f["base"]]) <= 3 for own in merged.units(now["files"]))
    referenced = {f["path"] for f in now["files"]} | set(now["dropped"])
    on_disk = {f"{p.parent.name}/{p.name}" for p in (tmp_path / "m").glob("*/_bucket=*")}
    assert on_disk == referenced  # what was dropped before the last commit is deleted


def test_a_small_batch_writes_little(spark, tmp_path):
    root = str(tmp_path / "m")
    merge = merged.merge_batch(root, ["t"], ["k"], buckets=4)
    whole = spark.range(200_000).select(F.col("id").cast("string").alias("k"), F.lit(0).alias("t"), F.xxhash64("id").alias("x"))
    merge(whole, 0)
    first = written(root, spark)
    for batch_id in range(1, 4):  # some keys of every bucket
        merge(whole.where(f"id % 1000 = {batch_id}").withColumn("t", F.lit(batch_id)), batch_id)
        assert written(root, spark) < first / 50
    merge(whole.withColumn("t", F.lit(4)), 4)
    assert written(root, spark) > first  # deltas as large as the table are merged into it
    assert all(len(own) == 1 for own in merged.units(commits.latest(spark, root)["files"]))
    assert merged.read_current(spark, root).count() == 200_000


def test_columns_may_come_later(spark, tmp_path):
    root = str(tmp_path / "m")
    merge = merged.merge_batch(root, ["t"], ["k"])
    merge(spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], ROWS), 0)
    merge(spark.createDataFrame([("a", 2, "new")], "k string, t int, note string"), 1)
    merge(spark.createDataFrame([], ROWS), 2)
    assert sorted(map(tuple, merged.read_current(spark, root).select("k", "t", "x", "note").collect())) == [
        ("a", 2, None, "new"), ("b", 1, 1, None)]


def test_indexed_sink_keeps_the_first(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(merged, "MOST_FILES", 2)
    monkeypatch.setattr(merged, "BUCKET_BYTES", 3_000)
    sink, rng, first = str(tmp_path / "s"), random.Random(9), {}
    append = merged.append_new_indexed(sink, ["k", "t"], ["x"], buckets=2)
    assert merged.read_indexed(spark, sink) is None
    for batch_id in range(7):
        rows = [(None if i % 50 == 7 else f"k{rng.randrange(120)}", None if i % 9 == 1 else rng.randrange(3), batch_id * 1000 + i) for i in range(90)]
        for k, t, x in rows:
            first.setdefault((k, t), x)
        for _ in range(2):
            append(spark.createDataFrame(rows, ROWS).repartition(3), batch_id)
        assert {(r.k, r.t): r.x for r in merged.read_indexed(spark, sink).collect()} == first
        assert merged.read_indexed(spark, sink).count() == len(first)
    assert commits.latest(spark, sink)["buckets"] > 2


def test_filters_pick_the_files(spark, tmp_path):
    sink = str(tmp_path / "s")
    append = merged.append_new_indexed(sink, ["k"], ["t"], buckets=32)
    rows = lambda ids: ids.select(F.col("id").cast("string").alias("k"), F.lit(0).alias("t"))
    append(rows(spark.range(20_000)), 0)
    append(rows(spark.range(100_000, 100_050)), 1)  # none of them is there: hardly a file is read
    assert commits.latest(spark, sink)["files_read"] <= 4
    append(rows(spark.range(5, 6)), 2)  # one that is there: its file, and hardly another
    assert 1 <= commits.latest(spark, sink)["files_read"] <= 2
    assert merged.read_indexed(spark, sink).count() == 20_050


def test_chat_messages(spark):
    message = lambda sender, chat, file: ((sender,) if sender else None, (chat,) if chat else None, file)
    rows = [(1, message(5, 9, ("abcdefghij", "a.pdf", 10)), None), (2, None, message(None, 5, ("abcdefghij", None, None))),
            (3, message(6, 9, ("x", "foreign.pdf", 1)), None), (4, message(5, 9, None), None), (5, None, None), (9, message(6, None, None), None)]
    updates = spark.createDataFrame(rows, ingest.CHAT_UPDATE)
    got = lambda **more: [(r.update_id, r.name, r["size"]) for r in ingest.chat_files(updates, 5, **more).collect()]
    assert got() == [(1, "a.pdf", 10), (2, "file_abcdefgh.bin", 0)]
    assert got(offset=2) == [(2, "file_abcdefgh.bin", 0)]
    assert ingest.next_offset(updates) == 10 and ingest.next_offset(updates.limit(0)) is None
