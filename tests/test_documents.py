"""Responses, offers, routing, schedules and strategies on small inputs."""

import pytest
from pyspark.sql import functions as F

from fenestra.operators import offers, quality, routing
from fenestra.operators.comparison import agreed_rows, diff_sources, index_by_mark
from fenestra.operators.consensus import consensus, consensus_evidence, with_unit_ids
from fenestra.operators.responses import accepted, anchor_units, page_reads, parse_responses, price_responses, read_units, rejected
from fenestra.operators.schedules import schedule_units, table_units
from fenestra.plans import strategies

UNIT = ('{"unit_id":"W1","panels":[{"role":"window","width_in":"72 1/2","height_in":88.5,"egress":"false"}],"qty":"10",'
        '"evidence":[{"page":0,"region":"schedule","bbox":[40,40,460,100]},7]}')


def parse(spark, *texts):
    return parse_responses(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, raw_text string"))


@pytest.mark.parametrize("text", [
    f"[{UNIT}]", f"```json\n[{UNIT}]\n```", f'{{"units":[{UNIT}]}}', f'{{"units":[],"data":[{UNIT}]}}', UNIT,
    f"Sure: [{UNIT}] and [more", f"open [ bracket, then {UNIT}", f"```\n{UNIT}\n```"])
def test_wrappings(spark, text):
    row = accepted(parse(spark, text)).first()
    assert (row.unit_id, row.kind, row.qty, row.confidence) == ("W1", "window", 10, .7)
    assert (row.panels[0].width_in, row.panels[0].egress) == (72.5, False)
    assert tuple(row.evidence[0].bbox) == (40.0, 40.0, 460.0, 100.0) and len(row.evidence) == 1


def test_items_are_read_as_a_whole(spark):
    """A path to a field that is not there costs many times one that is; most fields of most items are not there."""
    plan = parse(spark, f"[{UNIT}]")._jdf.queryExecution().optimizedPlan().toString()
    assert "try_variant_get" in plan and ", $." not in plan


def test_unreadable_answers_and_rejects(spark):
    assert accepted(parse(spark, "nothing", "[1, 2", "", "[]", None)).count() == 0
    bad = rejected(parse(spark, '["x",{"panels":[]},{"panels":[{"width_in":"a","height_in":1}]},'
                         '{"panels":[{"width_in":1,"height_in":1}],"qty":null},'
                         '{"panels":[{"width_in":1,"height_in":1}],"rough_opening":{"w_in":"z","h_in":1}}]'))
    assert [(r.unit_id, r.reject) for r in bad.orderBy("item_no").collect()] == [
        ("G1", "not an object"), ("G2", "no panels"), ("G3", "unreadable panel"), ("G4", "unreadable qty"),
        ("G5", "unreadable rough opening")]


def test_anchoring(spark):
    units = accepted(parse(spark, UNIT)).withColumn("page_no", F.lit(5))
    e = anchor_units(units, "page_no", F.lit(100.0), F.lit(10.0)).first().evidence[0]
    assert (e.page, tuple(e.bbox)) == (5, (140.0, 50.0, 460.0, 100.0))


def test_page_reads_and_prices(spark):
    pages = spark.createDataFrame([("a", 1, 'x {"readable":true,"confidence":"high","units":[{"mark":"A","qty":2}]} y'),
                                   ("a", 2, "no")], "doc_id string, page_no int, raw_text string")
    got = {r.page_no: (r.confidence, r.readable, len(r.units)) for r in page_reads(pages).collect()}
    assert got == {1: ("high", True, 1), 2: ("low", False, 0)}
    calls = spark.createDataFrame([("m", 1_000_000, 500_000), ("other", 1, 1)], "model string, in_tok int, out_tok int")
    prices = spark.createDataFrame([("m", 2.0, 10.0)], "model string, usd_in double, usd_out double")
    assert {r.model: r.cost_usd for r in price_responses(calls, prices).collect()} == {"m": 7.0, "other": None}


def price(item, unit, qty, total):
    return f"{item}\n1,000.00\n-\n{unit}\n-\n{qty}\n{total}\n9.00\nAccessories\n"


def sub(w, h, more=""):
    return f"Profile: X\nFrame size: {w} x {h}\n{more}Egress: YES TEMP\n"


def parsed(spark, *texts, **options):
    pages = spark.createDataFrame([("d", i + 1, t) for i, t in enumerate(texts)], "doc_id string, page_no int, text string")
    rows = offers.number_blocks(offers.offer_blocks(pages, **options)).orderBy("page_no", "block_no").collect()
    return rows, offers.offer_lines(pages)


def test_two_price_blocks_on_a_page(spark):
    text = sub("72 1/2", "88 1/2", "Rough opening: 73 1/4 x 89 1/4\n") + sub("36", "96") + price(1, "1,100.50", 2, "2,201.00") \
        + sub("40", "50") + price(2, "10.00", 3, "31.00")
    rows, lines = parsed(spark, text, "no offer here")
    assert [(r.mark, r.frame_w, r.frame_h, r.ro_w, r.qty) for r in rows] == [
        ("1.1", 72.5, 88.5, 73.25, 2), ("1.2", 36.0, 96.0, None, 2), ("2", 40.0, 50.0, None, 3)]
    total = offers.reconcile(lines, ["doc_id"]).first()
    assert (total.lines_seen, total.lines_failed, total.total_qty, total.reconciled) == (2, 1, 5, False)
    by_page, _ = parsed(spark, text, ro_scope="page")
    assert [r.ro_w for r in by_page] == [73.25] * 3


def test_price_first_and_missing_price(spark):
    rows, _ = parsed(spark, price(7, "1.00", 4, "4.00") + sub("30", "40") + sub("31", "41") + price(8, "2.00", 1, "2.00") + sub("32", "42"))
    assert [(r.mark, r.qty) for r in rows] == [("7.1", 4), ("7.2", 4), ("8", 1)]
    rows, lines = parsed(spark, "Frame size: 30 x 40 ANN", sub("1", "2"))
    assert [(r.mark, r.qty, r.glass, r.unit_price) for r in rows] == [("1", 0, "annealed", None), ("2", 0, "tempered", None)]
    assert lines.count() == 0


def test_routing_table(spark):
    signal = "doc_id string, has_schedule_sheet boolean, schedule_is_vector boolean, is_handwritten boolean"
    df = spark.createDataFrame([("e", False, False, False), ("r", True, False, False), ("v", True, True, False),
                                ("h", True, True, True)], signal)
    assert {r.doc_id: r.branch for r in routing.classify(df).collect()} == {"e": 3, "r": 2, "v": 1, "h": 4}


def test_route_signals(spark):
    body = "x" * 300
    rows = [("v", 1, "cover"), ("v", 2, "WINDOW SCHEDULE " + body), ("v", 3, "by Weather "), ("v", 4, " \n"), ("v", 5, "Shield Inc"),
            ("short", 1, "door schedule"), ("short", 2, body), ("scan", 1, ""), ("scan", 2, None), ("scan", 3, "a"), ("hand", 1, "")]
    pages = spark.createDataFrame(rows, "doc_id string, page_no bigint, text string")
    votes = spark.createDataFrame([("scan", 1, "PLAN"), ("scan", 2, "TABLE"), ("scan", 3, "HANDWRITTEN"), ("hand", 1, "HANDWRITTEN"),
                                   ("v", 1, "HANDWRITTEN")], "doc_id string, page_no bigint, vote string")
    got = {r.doc_id: r for r in routing.classify(routing.route_signals(pages, votes)).collect()}
    assert {d: r.branch for d, r in got.items()} == {"v": 1, "short": 3, "scan": 2, "hand": 4}
    assert got["v"].schedule_page_index == 1 and got["scan"].schedule_page_index == 1
    assert got["v"].notation_profile == "weather_shield"      # split over a page break and a blank page
    alone = {r.doc_id: r.is_handwritten for r in routing.route_signals(pages).collect()}
    assert alone == {"v": False, "short": False, "scan": True, "hand": True}


def cells(spark, *tables):
    rows = [("d", 1, t, r, c, text) for t, table in enumerate(tables) for r, line in enumerate(table) for c, text in enumerate(line)]
    return spark.createDataFrame(rows, "doc_id string, page_no int, table_no int, row_no int, col_no int, text string")


def test_first_column_headings_count(spark):
    table = cells(spark, [["Size", "Mark", "Qty"], ["30 x 40", "D1", "4"], ["bad", "W2", "1"]],
                  [["Qty", "Width", "Height", "glass"], ["7", "20", "30 1/2", None]], [["a", "b"], ["1", "2"]])
    strict = {r.unit_id: r for r in table_units(table, "v1").collect()}
    assert set(strict) == {"D1", "R0-1"}
    assert (strict["D1"].kind, strict["D1"].qty, strict["D1"].panels[0].width_in) == ("door", 4, 30.0)
    assert (strict["R0-1"].qty, strict["R0-1"].panels[0].height_in) == (7, 30.5)
    assert {r.unit_id for r in table_units(table, "v2").collect()} == {"D1", "7"}


def test_schedule_rows(spark):
    rows = spark.createDataFrame([("A", "2870", "7", "window"), ("D", "3180", "x", "Door"), ("E", "??", "1", None)],
                                 "mark string, size_code string, qty string, type string")
    got = sorted((r.unit_id, r.kind, r.qty, r.panels[0].width_in, r.panels[0].role) for r in schedule_units(rows).collect())
    assert got == [("A", "window", 7, 32.0, "window"), ("D", "door", 0, 37.0, "door")]
    other = spark.createDataFrame([("a", "28 70", "7", None), ("D", "3180", "2", "DR")], rows.schema)
    assert [tuple(r) for r in agreed_rows(rows, other).collect()] == [("A", "2870", 7, "window")]


def test_two_readings(spark):
    a = spark.sql("select map('#', ' w1 ', 'QTY', '2', 'TYPE', 'x') cells, 1 n union all select map('#', 'W1', 'QTY', '3', 'TYPE', 'x'), 2")
    b = spark.sql("select map('MARK', 'W1', 'QTY.', '3', 'Type', 'y') cells, 1 n union all select map('mark', 'W2', 'QTY', '1'), 2")
    out = diff_sources(index_by_mark(a, ["n"]), index_by_mark(b, ["n"]), ("QTY", "TYPE"))
    got = {(r.mark, r.column): (r.a, r.b, r.match) for r in out.collect()}
    assert got == {("W1", "QTY"): ("3", "3", True), ("W1", "TYPE"): ("x", "y", False),
                   ("W2", "QTY"): (None, "1", False), ("W2", "TYPE"): (None, None, True)}


def test_consensus(spark):
    panel = "array<struct<role string, width_in double, height_in double, glass string, u_factor double, egress boolean, clear_opening_sqft double>>"
    w = lambda width, glass=None: [("window", width, 60.0, glass, None, None, None)]
    e = [(1, "plan", (1.0, 2.0, 3.0, 4.0))]
    rows = [("schedule", 1, w(30.0), 5, ["B"], e), ("schedule", 2, w(30.1), 4, ["A"], e), ("plan", 1, w(30.0), 7, ["A"], e),
            ("notes", 1, w(40.0), 9, [], e), ("elevation", 1, w(50.0, "annealed"), 2, [], e), ("plan", 2, w(50.0, "annealed"), 3, [], e)]
    units = spark.createDataFrame(rows, f"source string, n int, panels {panel}, qty int, source_marks array<string>, "
                                  "evidence array<struct<page int, region string, bbox struct<x double, y double, w double, h double>>>"
                                  ).withColumns({"kind": F.lit("window"), "doc": F.lit("d")})
    got = {r.unit_id: r for r in with_unit_ids(consensus(units, ["doc"], ["n"]), ["doc"]).collect()}
    assert set(got) == {"A|B", "F2", "F3"}
    both = got["A|B"]
    assert (both.qty, both.n_sources, round(both.confidence, 2), both.panels[0].width_in) == (7, 2, .8, 30.0)
    assert both.flags == ["qty_mismatch_facade_schedule"]
    assert got["F2"].flags == ["mark_missing_from_schedule", "irc_r308_4_likely_tempered_required"] and got["F2"].qty == 3
    assert (got["F3"].qty, got["F3"].flags) == (9, [])
    assert consensus_evidence(units, ["doc"]).count() == 6


def test_quality(spark):
    rows = [("d", "A", 1, None, 30.0, 40.0), ("d", "B", None, "vlm_read", 0.0, 700.0), ("e", "C", 1, "vlm_read", 30.0, None)]
    units = spark.createDataFrame(rows, "doc string, mark string, qty int, qty_source string, width double, height double")
    checked = quality.unit_findings(units)
    found = sorted((r.mark, r.severity, r.rule) for r in quality.long_findings(checked, ["doc"]).collect())
    assert found == [("A", "warning", "qty without provenance"), ("B", "error", "implausible height"),
                     ("B", "error", "implausible width"), ("B", "warning", "qty missing")]
    lines = spark.createDataFrame([("e", False), ("e", False)], "doc string, ok boolean")
    unscored = spark.createDataFrame([("e",), ("d",)], "doc string")
    got = {r.doc: (r.n_errors, r.n_warnings, r.ok) for r in quality.quality_summary(checked, ["doc"], lines, unscored).collect()}
    assert got == {"d": (2, 2, False), "e": (1, 1, False)}
    with pytest.raises(ValueError):
        quality.stamp_qty_source(units, "guess")
    assert {r.qty_source for r in quality.stamp_qty_source(units, "unknown").collect()} == {"unknown", "vlm_read"}


def test_every_strategy_runs_on_a_canned_answer(spark):
    text = "W" * 60
    pages = spark.createDataFrame([("d", 1, text, 9, 3000, 2000), ("s", 1, "", 0, 3000, 2000)],
                                  "doc_id string, page_no int, text string, n_drawings int, width_px int, height_px int")
    regions = spark.createDataFrame([("d", 1, 100, 60, 900, 900), ("s", 1, 100, 60, 900, 900), ("s", 1, 0, 0, 50, 50)],
                                    "doc_id string, page_no int, x int, y int, w int, h int")
    answers = [(d, 1, r, s, f"[{UNIT}]", None) for d in "ds" for r in (0, 1, 2, 3, 4) for s in ("schedule", "plan")]
    responses = spark.createDataFrame(answers + [("d", 1, 1, "notes", None, "timeout")],
                                      "doc_id string, page_no int, region_no int, source string, raw_text string, error string")
    coarse = spark.createDataFrame([("d", 1, '[{"bbox_pct":[0.1,0.1,0.5,0.5]},{"bbox_pct":[0,0,0.001,1]},{}]', None)],
                                   "doc_id string, page_no int, raw_text string, error string")
    tables = {"pages": pages, "regions": regions, "coarse": coarse,
              "responses": responses.where("source = 'schedule' or error is not null"),
              "table_cells": cells(spark, [["Mark", "Size"], ["W9", "30 x 40"]])}
    count = lambda letter, t=tables: strategies.STRATEGIES[letter](t).count()
    assert (count("A"), count("B")) == (2, 2)
    assert count("C") == 2       # two tile columns hold the same unit at different places
    assert count("D") == 2       # the tiny region is dropped, the empty one is the whole page
    assert {(r.doc_id, r.mode) for r in strategies.STRATEGIES["E"](tables).collect()} == {("d", "vector"), ("s", "fallback B")}
    agents = strategies.STRATEGIES["F"]({**tables, "responses": responses}).collect()
    assert [(a.n_sources, a.qty) for a in agents] == [(2, 10), (2, 10)]
    skipped = strategies.skipped_pages(pages).collect()
    assert [(r.doc_id, r.reason) for r in skipped] == [("s", "all_pages_raster")]


def drawing_tables(spark):
    pages = spark.createDataFrame([("d", 1, "W" * 60, 9, 3000, 2000), ("s", 1, "", 0, 3000, 2000), ("n", None, "W" * 60, 9, 3000, 2000)],
                                  "doc_id string, page_no int, text string, n_drawings int, width_px int, height_px int")
    regions = spark.createDataFrame([(d, 1, x, 60, 900, 900) for d in "ds" for x in (100, 1500)] + [("s", 1, 0, 0, 50, 50)],
                                    "doc_id string, page_no int, x int, y int, w int, h int")
    answers = [(d, 1, r, f"[{UNIT},{UNIT},7]", None) for d in "dds" for r in (0, 1, 2, 3, 9)]
    responses = spark.createDataFrame(answers + [("d", 1, 1, None, "timeout"), ("d", 1, 1, "cannot read", None)],
                                      "doc_id string, page_no int, region_no int, raw_text string, error string")
    coarse = spark.createDataFrame([("d", 1, '[{"bbox_pct":[0.1,0.1,0.5,0.5]}]', None)], "doc_id string, page_no int, raw_text string, error string")
    return {"pages": pages, "regions": regions, "coarse": coarse, "responses": responses,
            "table_cells": cells(spark, [["Mark", "Size"], ["W9", "30 x 40"]])}


def test_strategies_share_what_was_read(spark):
    """Responses and regions that were read once give the same units as those that each strategy reads itself."""
    tables = drawing_tables(spark)
    shared = {n: t for n, t in tables.items() if n not in ("responses", "regions")} | {
        "units": strategies.response_units(tables["responses"]), "crops": strategies.numbered_regions(tables["regions"], tables["pages"])}
    for letter in "ABCDE":
        own, given = (strategies.STRATEGIES[letter](t) for t in (tables, shared))
        assert sorted(own.columns) == sorted(given.columns)
        rows = [sorted(map(str, df.select(*sorted(own.columns)).collect())) for df in (own, given)]
        assert rows[0] == rows[1] and rows[0], letter


def test_the_registry_reads_responses_once(spark, monkeypatch):
    """All strategies but the last get the same responses; tables are read once, not again for the documents without any."""
    from fenestra.plans import queries
    calls, staged = [], []
    read, keep = strategies.read_units, strategies.stage
    monkeypatch.setattr(strategies, "read_units", lambda df, *a: calls.append(df) or read(df, *a))
    monkeypatch.setattr(strategies, "stage", lambda df, label: staged.append(label) or keep(df, label))
    rows = queries.strategy_registry(spark, "/root/testdata/sf0.001").collect()
    assert sorted(r.letter for r in rows) == list("ABCDEF")
    assert len(calls) == 2 and staged == ["tiles", "table_units"]


def test_units_are_read_without_fields_that_nobody_asks_for(spark):
    texts = [f"[{UNIT}]", f"see ```json\n[{UNIT}]\n``` [1]", f" [{UNIT}]\n", '{"units":[{"panels":[{"width_in":"3/4","height_in":1e2}],"qty":"4"},null,3]}',
             '{"data":[{"panels":[{"width_in":true,"height_in":"36 3/16"}]}]}', '{"panels":[{"width_in":"1e2","height_in":1}]}',
             '[{"panels":[{"width_in":30.50,"height_in":"30.50\\""}],"evidence":"none"}]', '[{"panels":[null]}]', "[]", "nothing", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, raw_text string")
    got, want = read_units(df), accepted(parse_responses(df)).drop("raw_text")
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    sizes = {r.i: (r.panels[0].width_in, r.panels[0].height_in, r.qty, len(r.evidence)) for r in got.collect() if r.i > 2}
    assert sizes == {3: (0.75, 100.0, 4, 0), 4: (1.0, 36.1875, 1, 0), 6: (30.5, 30.5, 1, 0)}
    assert got.count() == 6
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    assert "elevation" in plan(got) and "elevation" not in plan(got.select("i", "qty"))


def test_tables_as_long_as_the_drawings_are_not_broadcast(spark):
    """Their few columns look small on disk; in the driver's memory they are not."""
    pages = spark.createDataFrame([(1, 1, "wall", 20, 3000, 2000)], "doc_id bigint, page_no bigint, text string, n_drawings int, width_px int, height_px int")
    regions = spark.createDataFrame([(1, 1, 100, 100, 900, 600)], "doc_id bigint, page_no bigint, x int, y int, w int, h int")
    answers = spark.createDataFrame([(1, 1, 1, "plan", f"[{UNIT}]", None)], "doc_id bigint, page_no bigint, region_no int, source string, raw_text string, error string")
    tables = {"pages": pages, "regions": regions, "responses": answers}
    coarse = answers.withColumn("raw_text", F.lit('[{"bbox_pct":[0.1,0.1,0.5,0.5]}]'))
    for units in (strategies.region_crops(tables), strategies.coarse_to_fine({**tables, "coarse": coarse})):
        assert "Broadcast" not in units._jdf.queryExecution().executedPlan().toString()
        assert [(r.unit_id, r.qty) for r in units.collect()] == [("W1", 10)]


def test_unit_files_are_compressed_and_bounded(spark, tmp_path, monkeypatch):
    from fenestra.sources import units as us
    monkeypatch.setattr(us, "MAX_FILE_UNITS", 2)
    units = accepted(parse(spark, f"[{UNIT},{UNIT},{UNIT}]")).withColumn("model", F.lit("m")).coalesce(1)
    us.write_units(units, str(tmp_path / "units"), ["model"])
    files = sorted(p.name for p in (tmp_path / "units").rglob("part-*"))
    assert len(files) == 2 and all(n.endswith(".json.gz") for n in files)
    assert [r.qty for r in us.read_units(spark, str(tmp_path / "units")).collect()] == [10, 10, 10]
