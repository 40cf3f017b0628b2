"""Metrics, leaderboards, files and streams."""

import json
import time

import pytest
from pyspark.sql import functions as F

from fenestra.operators import leaderboard as lb, metrics
from fenestra.operators.matching import match_units
from fenestra.operators.spec_groups import distinct_groups, group_units
from fenestra.sources import inventory, leaderboard_csv as lcsv, units as us
from fenestra.streaming import incremental, ingest

UNIT = ("run string, kind string, panels array<struct<role string, width_in double, height_in double, glass string, "
        "u_factor double, egress boolean>>, qty int")


def w(width, qty, glass="mixed", run="r", egress=True):
    return (run, "window", [("window", width, 60.0, glass, .24, egress)], qty)


def score(spark, pred, true, **o):
    pred, true = spark.createDataFrame(pred, UNIT), spark.createDataFrame(true, UNIT)
    frames = metrics.frame_totals(pred, ["run"]).join(metrics.frame_totals(true, ["run"], "true_frames"), ["run"], "full_outer")
    return metrics.score_matches(match_units(pred, true, ["run"], **o), ["run"], frames).first()


def test_metrics(spark):
    m = score(spark, [w(30.0, 8), w(80.0, 2)], [w(30.0, 10), w(50.0, 0)])
    assert (m.group_precision, m.group_recall, m.group_f1, m.qty_mae, m.unit_count_error) == (.5, .5, .5, 2.0, 0.0)
    m = score(spark, [w(30.0, 1, "annealed", egress=None)], [w(30.0, 1)])
    assert (m.glass_acc, m.ufactor_acc, m.egress_acc, m.frame_count_error) == (0.0, 1.0, 0.0, 0.0)
    m = score(spark, [], [w(30.0, 1)])
    assert (m.group_f1, m.hallucination_rate, m.miss_rate, m.qty_mae, m.glass_acc) == (0.0, 0.0, 1.0, None, None)
    m = score(spark, [w(30.0, 1)], [])
    assert (m.unit_count_error, m.hallucination_rate) == (0.0, 1.0)


def test_truth_against_itself_is_perfect(spark):
    truth = [w(30.0 + i, i + 1) for i in range(6)]
    m = score(spark, truth, truth)
    assert (m.group_f1, m.qty_mae, m.unit_count_error, m.glass_acc, m.pred_units_total) == (1.0, 0.0, 0.0, 1.0, 21)


def test_group_keys(spark):
    p = lambda width, glass: ("window", width, 60.0, glass, None, None)
    rows = [("r", "composite", [p(30.0, "mixed"), p(30.0, "annealed")], 1), ("r", "composite", [p(30.0, "annealed"), p(30.0, "mixed")], 2),
            ("r", "composite", [p(20.0, "mixed"), p(30.1, None)], 4), ("r", "composite", [p(30.0, None), p(20.1, "mixed")], 8)]
    units = spark.createDataFrame(rows, UNIT)
    qty = lambda mode: sorted(r.qty for r in group_units(units, ["run"], mode=mode).collect())
    assert qty("full") == [1, 2, 12]     # equal sizes keep their order, so swapped glass does not fold
    assert qty("dims") == [3, 12]
    assert distinct_groups(units, ["run"]).first().n_groups == 3


def test_gap_recall(spark):
    true = spark.createDataFrame([("a", "g1"), ("a", "g2")], "k string, gap_id string")
    scopes = spark.createDataFrame([("a",), ("b",)], "k string")
    got = {r.k: r.gap_recall for r in metrics.gap_recall(true.limit(1), true, ["k"], scopes=scopes).collect()}
    assert got == {"a": .5, "b": 1.0}


BOARD = ("variant string, model string, project string, gt_level string, group_f1 double, qty_mae double, "
         "unit_count_error double, cost_usd double, error string, t int")


def board(spark, *rows):
    return spark.createDataFrame([(v, m, "p", "extraction", f1, mae, uce, c, err, i) for i, (v, m, f1, mae, uce, c, err) in enumerate(rows)], BOARD)


def test_winner_takes_zero_as_best(spark):
    rows = board(spark, ("A", "m", .8, .5, 0.0, 1.0, None), ("B", "m", .8, 0.0, .05, 9.0, None), ("C", "m", .8, None, 0.0, 0.0, None),
                 ("D", "m", .99, 0.0, .06, 0.0, None), ("E", "m", .99, 0.0, None, 0.0, None))
    won = lb.pick_winner(rows, "p")
    assert won.first().variant == "B"
    assert lb.tag_winners(rows, won).where("is_winner").count() == 1
    assert lb.pick_winner(rows, "other").count() == 0
    assert lb.best_by_f1(rows.withColumn("error", F.when(F.col("variant") == "D", "x")), "p").first().variant == "E"


def test_gates(spark):
    rows = board(spark, ("A", "m", .95, .5, .05, 1.0, None), ("B", "m", .7, None, .01, 1.0, None), ("C", "m", None, None, None, None, None))
    limits = {k: lb.GATE[k] for k in ("unit_count_error", "group_f1", "qty_mae")}
    got = {r.variant: (r.gate_pass, r.gate_reasons) for r in lb.gate(rows, limits).collect()}
    assert got["A"] == (True, []) and got["B"] == (False, ["group_f1=0.700 < 0.9", "qty_mae: NO DATA"])
    assert lb.gate(rows).where("gate_pass").count() == 0
    assert {r.variant: r.gate for r in lb.short_gate(rows).collect()} == {"A": "PASS", "B": "PASS", "C": "—"}
    summary = {r.variant: (r.cells, r.n_pass, r.pass_pct) for r in lb.strategy_summary(rows).collect()}
    assert summary["A"] == (1, 1, 100.0) and summary["F"] == (0, None, None) and len(summary) == 6


def test_delta_keeps_unknown_unknown(spark):
    now = board(spark, ("A", "m", .9, None, .1, None, None))
    before = spark.createDataFrame([("A", "m", "p", .5, 1), ("A", "m", "p", .6, 2)], "variant string, model string, project string, ext_group_f1 double, t int")
    delta = lb.round_delta(now, before.withColumn("unit_count_error", F.lit(None).cast("double")), ["t"], {"ext_group_f1": "group_f1"}).first()
    assert (round(delta.f1_change, 6), delta.uce_change) == (.3, None)


def test_missing_cells_and_facts(spark):
    rows = board(spark, ("A", "m", 1., 1., 1., 1., None), ("*", "*", 1., 1., 1., 1., "cap"))
    assert {(r.variant, r.model) for r in lb.missing_cells(spark, ["A", "B"], ["m"], ["p"], rows).collect()} == {("B", "m")}
    facts = lb.title_facts(rows).first()
    assert (facts.n_rows, facts.variants, facts.n_models) == (2, "A", 1)


def test_csv_files_with_clashing_headers(spark, tmp_path):
    (tmp_path / "leaderboard_1.csv").write_text("variant,model,project,gt_level,group_f1,error\nA,m,p,extraction,0.5,\"two\nlines\"\nB,m,p,extraction,,\n")
    time.sleep(1.1)
    (tmp_path / "leaderboard_2.csv").write_text("model,variant,cost_usd,project,gt_level,n_units\nm,A,1e-2,p,extraction,7\nm,A,0.5,p,extraction,8\n")
    (tmp_path / "notes.csv").write_text("hello\nworld\n")
    raw = lcsv.read_leaderboards(spark, str(tmp_path))
    assert raw.where("error = 'two\nlines'").count() == 1
    got = {r.variant: r for r in lcsv.merge_leaderboards(spark, str(tmp_path)).collect()}
    assert set(got) == {"A", "B"}
    assert (got["A"].cost_usd, got["A"].n_units, got["A"].group_f1) == (.5, 8, None)
    assert got["B"].group_f1 is None and got["B"].cost_usd is None
    assert lcsv.merge_leaderboards(spark, str(tmp_path)).columns == sorted(got["A"].asDict())


def test_partials_replace_only_their_folder(spark, tmp_path):
    path = str(tmp_path / "parts")
    rows = board(spark, ("A", "x:1", .1, 1., 1., 1., None), ("B", "x:1", .2, 1., 1., 1., None))
    lcsv.write_partials(rows, path)
    lcsv.write_partials(rows.where("variant = 'B'").withColumn("group_f1", F.lit(.9)), path)
    got = {r.variant: r.group_f1 for r in lcsv.merge_leaderboards(spark, path).collect()}
    assert got == {"A": .1, "B": .9}
    lcsv.write_leaderboard(rows, str(tmp_path / "one"))
    assert spark.read.option("header", True).csv(str(tmp_path / "one")).columns == sorted(rows.columns)


def test_unit_lines(spark, tmp_path):
    lines = [json.dumps({"unit_id": "W1", "kind": "window", "qty": 2, "panels": [{"role": "window", "width_in": 30, "height_in": 40}],
                         "evidence": [{"page": 1, "region": "plan", "bbox": [1, 2, 3, 4]}]}), "", "{broken", json.dumps({"kind": "door"})]
    (tmp_path / "u.jsonl").write_text("\n".join(lines))
    rows = us.read_units(spark, str(tmp_path / "u.jsonl")).collect()
    assert sorted(str(r.reject) for r in rows) == ["None", "missing unit_id, qty", "unparseable line"]
    good = [r for r in rows if r.reject is None][0]
    assert (good.confidence, good.flags, good.evidence[0].bbox.h) == (1.0, [], 4.0)
    df = us.read_units(spark, str(tmp_path / "u.jsonl")).where("reject is null").withColumn("model", F.lit("a/b:c"))
    us.write_units(df, str(tmp_path / "out"), ["model"])
    back = us.read_units(spark, str(tmp_path / "out")).first()
    assert back.model == "a_b_c" and tuple(back.evidence[0].bbox) == (1.0, 2.0, 3.0, 4.0)


def test_truth_and_transcripts(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"project": "p", "totals": {"units": 3, "frames": 5}, "units": [
        {"unit_id": "A", "kind": "window", "qty": 3, "panels": [], "extra": 1}]}, indent=1))
    row = us.read_truth(spark, str(tmp_path / "t.json"), "offer").first()
    assert (row.project, row.gt_level, row.true_frames, row.unit_id, row.source_marks) == ("p", "offer", 5, "A", [])
    (tmp_path / "s.json").write_text(json.dumps({"window_schedule": [{"#": "A", "QTY.": "2"}, {"MARK": "B"}]}))
    rows = us.read_transcript(spark, str(tmp_path / "s.json"), "x").orderBy("row_no").collect()
    assert [r.cells for r in rows] == [{"#": "A", "QTY.": "2"}, {"MARK": "B"}]


def test_inventory(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"1" * 10)
    (tmp_path / "b.pdf").write_bytes(b"1" * 99)
    expected = spark.createDataFrame([("a.pdf",), ("b.pdf",), ("c.pdf",)], "name string")
    files = inventory.list_files(spark, str(tmp_path), "*.pdf")
    assert {r.name: r.status for r in inventory.inventory(expected, files, 50).collect()} == {
        "a.pdf": "OK", "b.pdf": "TOO_LARGE", "c.pdf": "MISSING"}
    assert "content" not in files._jdf.queryExecution().executedPlan().toString()


def test_file_stream_twice(spark, tmp_path):
    drop, sink, offsets = (str(tmp_path / n) for n in ("drop", "sink", "offsets"))
    (tmp_path / "drop").mkdir()

    def names_after_run():
        stream = ingest.drop_repeats(ingest.watch_files(spark, drop, "*.pdf"), ["name", "size"], "mtime", "30 days")
        query = ingest.run_once(stream, sink, offsets)
        progress = ingest.progress_rows(spark, query)
        assert progress.columns[:4] == ["name", "id", "batch_id", "rows_in"]
        assert sum(r.rows_in for r in progress.collect()) <= 1
        return sorted(r.name for r in spark.read.parquet(sink).collect())

    (tmp_path / "drop" / "a.pdf").write_bytes(b"x")
    (tmp_path / "drop" / "skip.txt").write_bytes(b"x")
    assert names_after_run() == ["a.pdf"]
    assert names_after_run() == ["a.pdf"]
    (tmp_path / "drop" / "b.pdf").write_bytes(b"yy")
    assert names_after_run() == ["a.pdf", "b.pdf"]


def test_append_new_needs_no_state(spark, tmp_path):
    sink = str(tmp_path / "sink")
    append = ingest.append_new(sink, ["k"], ["t"])
    rows = lambda *r: spark.createDataFrame(r, "k string, t int")
    for i, batch in enumerate((rows(("a", 2), ("a", 1), (None, 3)), rows(("a", 0), ("b", 5), (None, 1)), rows(("b", 5)))):
        append(batch, i)
    assert sorted((r.k or "", r.t) for r in spark.read.parquet(sink).collect()) == [("", 3), ("a", 1), ("b", 5)]


def test_small_sinks(spark, tmp_path):
    rows = board(spark, ("A", "m", .123456, 1., 1., 1.23456, None)).withColumn("elapsed_sec", F.lit(1.239))
    based = lb.base_row(rows).first()
    assert (based.elapsed_sec, based.cost_usd) == (1.24, 1.2346)
    us.write_report(rows, str(tmp_path / "report"), "v1")
    back = spark.read.json(str(tmp_path / "report")).first()
    assert back.version == "v1" and back.generated
    variants = spark.createDataFrame([("v1", "W1"), ("v2", "W1")], "variant_id string, unit_id string")
    us.write_variants(variants, str(tmp_path / "variants"))
    assert sorted(p.name for p in (tmp_path / "variants").glob("variant_id=*")) == ["variant_id=v1", "variant_id=v2"]


def test_append_only_new_work(spark, tmp_path):
    path = str(tmp_path / "done")
    pages = spark.range(6).withColumnRenamed("id", "page")
    incremental.append_pending(spark.createDataFrame([(0,), (0,)], "page bigint"), path, ["page"])
    for upto, expected in ((3, 3), (3, 3), (6, 6)):
        incremental.append_pending(pages.where(f"page < {upto}"), path, ["page"])
        assert spark.read.parquet(path).count() == expected


def test_append_keeps_the_first_request_and_null_keys(spark, tmp_path):
    path = str(tmp_path / "done")
    rows = spark.createDataFrame([("a", 2), ("a", 1), (None, 5), (None, 4)], "k string, n int")
    for _ in range(2):
        incremental.append_pending(rows.repartition(4), path, ["k"])
    assert sorted((r.k or "", r.n) for r in spark.read.parquet(path).collect()) == [("", 4), ("a", 1)]
