"""Driver-facing queries: every operator over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fenestra.functions import cells as ce, codes, geometry as ge, inches, text as tx
from fenestra.operators import (comparison, consensus as cons, discovery, injection, leaderboard as lb, matching,
                                metrics, offers, overlaps, quality, review, routing, rules, schedules, spec_groups)
from fenestra.operators.ordered import row_numbers
from fenestra.operators.responses import accepted, anchor_units, parse_responses, price_responses, rejected
from fenestra.plans import branches, standins as si, strategies
from fenestra.session import stage, staged_path
from fenestra.sources import inventory as inv, leaderboard_csv as lcsv, units as us
from fenestra.streaming import incremental, ingest, merged, runs as run_files

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    _REGISTRY[fn.__name__] = fn
    return fn


def all_queries() -> dict[str, Query]:
    return dict(_REGISTRY)


def _r(c: str | Column, digits: int = 6) -> Column:
    name = c if isinstance(c, str) else None
    out = F.round(F.col(c) if name else c, digits)
    return out.alias(name) if name else out


def _first(field: str) -> Column:
    return F.get("panels", F.lit(0))[field]


def _flags(c: str) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(c)), ",")


# -- measurements and notations ------------------------------------------------

@query
def parse_inches_codes(spark, sf):
    """Fractional inches, four-digit codes and literal sizes written from part columns, read back."""
    k, s = F.col("p_partkey"), F.col("p_size")
    measure = F.when(k % 17 == 0, "n/a").when(k % 19 == 0, F.concat(s.cast("string"), F.lit("/0"))).otherwise(
        F.concat_ws("", (20 + s).cast("string"), F.lit(" "), (k % 16).cast("string"), F.lit('/16"')))
    quad = F.concat_ws("", (1 + s % 9).cast("string"), (k % 10).cast("string"), (1 + k % 9).cast("string"),
                       (s % 10).cast("string"))
    code = F.when(k % 3 == 0, quad).otherwise(F.concat_ws("", (1 + k % 3).cast("string"), F.lit("-"), quad))
    literal = F.concat_ws("", (1 + s % 9).cast("string"), F.lit("'-"), (k % 10).cast("string"), F.lit('" x '),
                          (1 + k % 9).cast("string"), F.lit("'-"), (s % 10).cast("string"), F.lit(' 1/2"'))
    profile = F.when(F.col("p_type") == "PROMO", "other").otherwise("weather_shield")
    d = si.table(spark, sf, "part").select(
        k, inches.parse_inches(measure).alias("m"), codes.decode(code, profile).alias("c"),
        codes.decode(literal, profile).alias("l"))
    return d.select("p_partkey", F.col("m.value").alias("inches"), F.col("m.error").isNotNull().alias("bad_inches"),
                    F.col("c.width_in").alias("code_w"), F.col("c.height_in").alias("code_h"),
                    F.col("c.mull_count").cast("bigint").alias("mull_count"), F.col("c.error").alias("code_error"),
                    F.col("l.width_in").alias("literal_w"), F.col("l.height_in").alias("literal_h"))


@query
def rounding_buckets(spark, sf):
    """Half-even size buckets and U-factor labels of every order line."""
    v = F.col("l_extendedprice") / 64
    return si.table(spark, sf, "lineitem").groupBy(
        inches.ufactor_bucket(0.2 + F.col("l_tax") + F.col("l_discount") / 4).alias("u_bucket")).agg(
        F.sum(inches.round_steps(v)).alias("steps"), F.count(F.lit(1)).alias("n"))


@query
def provider_specs(spark, sf):
    """Model specs, slugs and safe ids from event types, with token prices (unknown stays NULL)."""
    spec = F.concat_ws(":", F.lit("vendor"), F.concat(F.col("event_type"), F.lit("/v"), F.col("user_id") % 3))
    calls = si.table(spark, sf, "events").select(
        spec.alias("spec"), F.col("event_type").alias("model"), (F.col("user_id") * 10).alias("in_tok"),
        F.get_json_object("props", "$.k").cast("bigint").alias("out_tok"))
    prices = spark.createDataFrame([("click", 2.5, 10.0), ("view", 0.15, 0.6), ("signup", 15.0, 75.0)],
                                   "model string, usd_in double, usd_out double")
    priced = price_responses(calls, prices).withColumns({
        "provider": tx.provider_name(F.col("spec")), "slug": tx.model_slug(tx.provider_model(F.col("spec"))),
        "safe": tx.safe_id(F.col("spec"))})
    return priced.groupBy("provider", "slug", "safe").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("cost_usd").isNull()).alias("unpriced"),
        _r(F.sum("cost_usd"), 6).alias("cost_usd"))


# -- spec groups, matching, metrics --------------------------------------------

@query
def bucketed_spec_groups(spark, sf):
    groups = spec_groups.group_units(si.line_units(spark, sf), ["supplier"])
    return groups.select("supplier", spec_groups.key_text(F.col("kind"), F.col("key_panels")).alias("spec_key"),
                         "qty", "n_units")


@query
def spec_groups_by_size(spark, sf):
    groups = spec_groups.group_units(si.line_units(spark, sf), ["supplier"], mode="dims")
    return groups.select("supplier", spec_groups.key_text(F.col("kind"), F.col("key_panels")).alias("spec_key"),
                         "qty", "n_units")


@query
def distinct_groups(spark, sf):
    units = si.line_units(spark, sf)
    wide = spec_groups.distinct_groups(units, ["supplier"])
    full = spec_groups.distinct_groups(units, ["supplier"], heights=True).withColumnRenamed("n_groups", "n_sizes")
    return wide.join(full, "supplier")


@query
def ro_to_frame(spark, sf):
    """Offer form of units whose rough opening is known."""
    units = si.line_units(spark, sf).withColumn("rough_opening", F.when(F.col("discount") > 0, F.struct(
        (_first("width_in") + 1.0).alias("w_in"), (_first("height_in") + 1.5).alias("h_in"))))
    legacy = discovery.ro_to_frame(F.col("rough_opening.w_in"), F.col("rough_opening.h_in"), F.col("kind"), 0.5)
    return discovery.to_offer_form(units).select(
        "project", "unit_id", "kind", _first("width_in").alias("frame_w"), _first("height_in").alias("frame_h"),
        F.size("panels").cast("bigint").alias("n_panels"), legacy["w"].alias("legacy_w"))


def _part_groups(spark, sf, predicted: bool):
    units = si.part_units(spark, sf)
    if predicted:
        shift = F.when(F.col("size") % 3 == 0, 0.5).when(F.col("size") % 3 == 1, 1.5).otherwise(0.0)
        units = units.withColumn("panels", F.transform("panels", lambda p: p.withField(
            "width_in", p["width_in"] + shift)))
    return spec_groups.group_units(units, ["project"])


@query
def tolerance_match_edges(spark, sf):
    edges = matching.candidate_edges(_part_groups(spark, sf, True), _part_groups(spark, sf, False), ["project"])
    return edges.select(F.col("block.project").alias("project"), F.col("block.kind").alias("kind"),
                        "p", "t", "d", "supply", "demand")


@query
def tolerance_match(spark, sf):
    """One-to-one assignment within one inch per panel; orders are projects."""
    truth = si.line_units(spark, sf)
    out = matching.match_units(si.predicted_units(truth), truth, ["project"], bound_by=si.line_projects(spark, sf))
    return out.select("project", "kind", spec_groups.key_text(F.col("kind"), F.col("pred_panels")).alias("pred_key"),
                      spec_groups.key_text(F.col("kind"), F.col("true_panels")).alias("true_key"),
                      "pred_qty", "true_qty", "distance", "status")


@query
def tolerance_match_dense(spark, sf):
    """The same on brands, whose sizes form connected components; totals per brand."""
    out = matching.match_groups(_part_groups(spark, sf, True), _part_groups(spark, sf, False), ["project"])
    return out.groupBy("project", "kind").agg(
        F.count_if(F.col("status") == "matched").alias("matched"),
        F.count_if(F.col("status") == "false_positive").alias("fp"),
        F.count_if(F.col("status") == "miss").alias("fn"), F.sum("distance").alias("distance"),
        F.sum("pred_qty").alias("pred_qty"), F.sum("true_qty").alias("true_qty"))


def _lattice_units(keys, number):
    """Windows of one project on a lattice of sizes, so that most of them belong to one component."""
    k = F.col(number)
    glass = F.when(k % 4 == 0, "tempered")
    panels = si.panels_of(F.lit("window"), 30 + F.pmod(k * 7, F.lit(31)) / 2, 60 + F.pmod(k * 11, F.lit(29)) / 2, glass)
    return keys.select(F.lit("all").alias("project"), F.lit("window").alias("kind"), panels.alias("panels"), (1 + k % 5).cast("int").alias("qty"))


@query
def tolerance_match_large(spark, sf):
    """Parts of one remainder against those of another, all in one project: a component of thousands of size pairs."""
    part = si.table(spark, sf, "part")
    side = lambda r: _lattice_units(part.where(F.col("p_partkey") % 3 == r), "p_partkey")
    out = matching.match_units(side(0), side(1), ["project"])
    return out.select("project", spec_groups.key_text(F.col("kind"), F.col("pred_panels")).alias("pred_key"),
                      spec_groups.key_text(F.col("kind"), F.col("true_panels")).alias("true_key"), "pred_qty", "true_qty", "distance", "status")


def _metric_columns(df, scope):
    rounded = ["group_precision", "group_recall", "group_f1", "qty_mae", "unit_count_error", "frame_count_error",
               "glass_acc", "ufactor_acc", "egress_acc", "hallucination_rate", "miss_rate"]
    return df.select(*scope, *[_r(c) for c in rounded], "matched_groups", "fp_groups", "fn_groups",
                     "pred_units_total", "gt_units_total")


@query
def match_metrics(spark, sf):
    """All metrics per order with exact size keys."""
    truth = si.line_units(spark, sf)
    pred = si.predicted_units(truth)
    frames = metrics.frame_totals(pred, ["project"]).join(
        metrics.frame_totals(truth, ["project"], "true_frames"), "project")
    out = metrics.score_matches(matching.match_units(pred, truth, ["project"], tau_in=0.0, bound_by=si.line_projects(spark, sf)), ["project"], frames)
    return _metric_columns(out, ["project"])


@query
def scores_without_truth(spark, sf):
    """Every fourth order has no truth: its runs stay, with their units and without metrics."""
    units = si.line_units(spark, sf)
    pred, truth = si.predicted_units(units), units.where("project % 4 != 0")
    out = metrics.score_matches(matching.match_units(pred, truth, ["project"], tau_in=0.0), ["project"], truth=truth)
    return out.select("project", _r("group_f1"), _r("unit_count_error"), _r("hallucination_rate"), "matched_groups",
                      "pred_units_total")


@query
def tolerance_metrics(spark, sf):
    """All metrics per order with the default tolerance."""
    truth = si.line_units(spark, sf)
    pred = si.predicted_units(truth)
    matches = matching.match_units(pred, truth, ["project"], bound_by=si.line_projects(spark, sf))
    return _metric_columns(metrics.score_matches(matches, ["project"]), ["project"])


@query
def both_level_metrics(spark, sf):
    """Extraction and offer level scored in one pass over the same units."""
    grown = lambda p: p.withField("width_in", p["width_in"] + 0.75).withField("height_in", p["height_in"] + 0.75)
    truth = si.part_units(spark, sf)
    offer_truth = truth.withColumn("gt_level", F.lit("offer"))
    drawn = truth.withColumn("rough_opening", F.struct(
        (_first("width_in") + 0.75).alias("w_in"), (_first("height_in") + 0.75).alias("h_in"))).withColumn(
        "panels", F.transform("panels", lambda p, i: F.when(i == 0, grown(p)).otherwise(p)))
    both_truth = offer_truth.unionByName(drawn.drop("rough_opening").withColumn("gt_level", F.lit("extraction")))
    scope = ["project", "gt_level"]
    matches = matching.match_units(discovery.both_levels(drawn), both_truth, scope, tau_in=0.0)
    return metrics.score_matches(matches, scope).select(*scope, _r("group_f1"), "matched_groups", "fp_groups",
                                                         "fn_groups", "pred_units_total")


@query
def gap_recall(spark, sf):
    """Share of the gap ids of a user that an expensive event reported."""
    e = si.table(spark, sf, "events")
    true = e.select("user_id", F.col("event_type").alias("gap_id")).distinct()
    predicted = e.where("value > 40").select("user_id", F.col("event_type").alias("gap_id"))
    users = si.table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"))
    return metrics.gap_recall(predicted, true, ["user_id"], scopes=users).select("user_id", _r("gap_recall"))


@query
def flag_vs_label(spark, sf):
    """Recall and precision of a text rule against the labels, per source."""
    docs = si.table(spark, sf, "documents").select("doc_id", "source", F.col("text").rlike(r"[0-9@]").alias("flagged"))
    labels = si.table(spark, sf, "labels").select("doc_id", ((F.col("toxic") == 1) | (F.col("quality") == 0))
                                                  .alias("injected"))
    return metrics.flag_rates(docs.join(labels, "doc_id"), ["source"]).select(
        "source", _r("error_recall"), _r("error_precision"))


# -- offers ---------------------------------------------------------------------

@query
def reconcile_lines(spark, sf):
    unit = F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100) / F.lit(100.0)
    total = F.col("l_extendedprice") + F.when(F.col("l_linenumber") % 7 == 0, 10.0).otherwise(0.0)
    lines = si.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), unit.cast("decimal(18,2)").alias("unit_price"),
        F.when(F.col("l_returnflag") != "N", F.col("l_quantity").cast("int")).alias("qty"),
        total.cast("decimal(18,2)").alias("line_total"))
    out = offers.reconcile(offers.check_lines(lines), ["doc_id"])
    return out.withColumn("coverage", F.round("coverage", 6))


@query
def offer_block_parse(spark, sf):
    blocks, _ = branches.offer_branch(stage(si.offer_pages(spark, sf), "pages"))
    double = lambda c: F.col(c).cast("double").alias(c)
    return blocks.select("doc_id", "page_no", "mark", "frame_w", "frame_h", "ro_w", "ro_h",
                         F.col("qty").cast("bigint").alias("qty"), "glass", "egress", double("unit_price"),
                         double("line_total"))


@query
def offer_columns(spark, sf):
    """Sub-units of offers under the common column names."""
    blocks, _ = branches.offer_branch(stage(si.offer_pages(spark, sf), "pages"))
    return offers.offer_schema(blocks).withColumn("qty", F.col("qty").cast("bigint"))


@query
def offer_line_check(spark, sf):
    _, lines = branches.offer_branch(stage(si.offer_pages(spark, sf), "pages"))
    out = offers.reconcile(lines, ["doc_id"])
    return out.withColumn("coverage", F.round("coverage", 6))


# -- routing --------------------------------------------------------------------

@query
def route_documents(spark, sf):
    pages = si.document_pages(spark, sf)
    routed = routing.classify(routing.route_signals(pages, si.page_votes(spark, sf, pages)))
    return routed.select("doc_id", "n_pages", _r("vector_page_frac"), "has_schedule_sheet", "schedule_is_vector",
                         "is_handwritten", "notation_profile", "schedule_page_index",
                         F.col("branch").cast("bigint").alias("branch"), "branch_name")


@query
def keyword_rank_pages(spark, sf):
    return routing.elevation_pages(si.elevation_text_pages(spark, sf)).select(
        "doc_id", "page_no", "level_hits", "score", F.col("rank").cast("bigint").alias("rank"))


@query
def page_sample(spark, sf):
    pages = si.table(spark, sf, "conversations").select(
        F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("page_no"), "role", "text")
    return routing.sample_pages(pages).select("doc_id", "page_no", "role", F.length("text").alias("n_chars"))


# -- responses and strategies ----------------------------------------------------

@query
def json_units(spark, sf):
    """Strategy A: whole-page responses in every wrapping, typed and anchored to their page."""
    units = strategies.whole_page({"responses": si.unit_responses(spark, sf)})
    ev = F.get("evidence", F.lit(0))
    return units.select("doc_id", "unit_id", "kind", F.col("qty").cast("bigint").alias("qty"),
                        _first("width_in").alias("width_in"), _first("height_in").alias("height_in"),
                        _first("glass").alias("glass"), _first("egress").alias("egress"), "confidence",
                        ev["page"].cast("bigint").alias("page"), ev["bbox"]["x"].alias("x"))


@query
def json_rejects(spark, sf):
    """Response items that cannot be used, by reason."""
    rows = parse_responses(strategies.usable(si.unit_responses(spark, sf)))
    return rejected(rows).groupBy("unit_id", "reject").agg(F.count(F.lit(1)).alias("n"))


def _drawing(spark, sf):
    pages = si.order_pages(spark, sf)
    return {"pages": pages, "regions": si.order_regions(pages), "responses": si.crop_responses(pages)}


@query
def region_numbers(spark, sf):
    tables = _drawing(spark, sf)
    return strategies.numbered_regions(tables["regions"], tables["pages"]).select(
        "doc_id", "page_no", "region_no", *[F.col(c).cast("bigint").alias(c) for c in "xywh"])


def _unit_view(units):
    ev = F.get("evidence", F.lit(0))
    return units.select("doc_id", "page_no", F.col("region_no").cast("bigint").alias("region_no"), "unit_id",
                        F.col("qty").cast("bigint").alias("qty"), _first("width_in").alias("width_in"),
                        ev["page"].cast("bigint").alias("page"), ev["bbox"]["x"].alias("x"), ev["bbox"]["y"].alias("y"))


@query
def strategy_region_crops(spark, sf):
    return _unit_view(strategies.region_crops(_drawing(spark, sf)))


@query
def strategy_tiles(spark, sf):
    out = strategies.tiled(_drawing(spark, sf))
    return _unit_view(out).join(out.select("doc_id", "page_no", "region_no", "n_merged"),
                                ["doc_id", "page_no", "region_no"])


@query
def strategy_coarse_to_fine(spark, sf):
    tables = _drawing(spark, sf)
    return _unit_view(strategies.coarse_to_fine({**tables, "coarse": si.coarse_responses(tables["pages"])}))


@query
def strategy_tables_first(spark, sf):
    tables = _drawing(spark, sf)
    out = strategies.tables_first({**tables, "table_cells": si.schedule_cells(spark, sf),
                                   "table_documents": si.schedule_documents(spark, sf)})
    return out.groupBy("doc_id", "mode").agg(F.count(F.lit(1)).alias("n_units"), F.sum(F.col("qty").cast("bigint")).alias("qty"))


@query
def strategy_agents(spark, sf):
    pages = si.order_pages(spark, sf)
    out = strategies.agents({"pages": pages, "regions": si.order_regions(pages),
                             "responses": si.crop_responses(pages, sources=True)})
    return out.select("doc_id", "unit_id", "kind", F.col("qty").cast("bigint").alias("qty"),
                      F.col("n_sources").cast("bigint").alias("n_sources"), _r("confidence"),
                      _flags("flags").alias("flags"))


@query
def skipped_pages(spark, sf):
    return strategies.skipped_pages(si.order_pages(spark, sf))


@query
def grid_tiles(spark, sf):
    tiles = strategies.page_tiles(si.order_pages(spark, sf), 1024, 0.18)
    return tiles.groupBy("page_no").agg(F.count(F.lit(1)).alias("n_tiles"), F.sum("x").alias("sum_x"),
                                        F.sum("y").alias("sum_y"), F.max("region_no").cast("bigint").alias("last"))


@query
def iou_pairs(spark, sf):
    """Overlapping box pairs of a label on a page of a hundred boxes; boxes are four values of each vector."""
    part = lambda i: F.get("embedding", F.lit(i)).cast("double")
    boxes = si.table(spark, sf, "embeddings").select(
        "label", F.floor(F.col("vec_id") / 100).alias("page"), "vec_id", ge.box(part(0) * 100, part(1) * 100, 20 + F.abs(part(2)) * 100,
                                                      20 + F.abs(part(3)) * 100).alias("b"))
    return overlaps.overlap_pairs(boxes, ["label", "page"], "vec_id", "b").select(
        F.col("label").cast("bigint").alias("label"), "page", "a_id", "b_id", _r("iou"))


@query
def dedup_boxes(spark, sf):
    lines = si.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("doc_id"))
    out = overlaps.dedup_overlaps(si.boxed_units(spark, sf), ["doc_id"], ["page_no", "region_no", "item_no"], bound_by=lines)
    return out.select("doc_id", "unit_id", "kind", F.col("qty").cast("bigint").alias("qty"), "confidence", "n_merged")


def _supplier_groups(spark, sf, units):
    """Named spec groups per supplier; a supplier has at most as many units as order lines."""
    lines = si.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("supplier"))
    groups = cons.consensus(units, ["supplier"], ["project", "line", "partkey"], bound_by=lines)
    return cons.with_unit_ids(groups, ["supplier"], bound_by=lines)


@query
def consensus(spark, sf):
    """Four sources per supplier reconciled by spec group."""
    names = F.array(*[F.lit(s) for s in cons.SOURCES])
    units = si.line_units(spark, sf).withColumn("source", F.get(names, (F.col("line") % 4).cast("int"))).withColumn(
        "evidence", F.array().cast("array<struct<page:int,region:string,bbox:struct<x:double,y:double,w:double,h:double>>>"))
    out = _supplier_groups(spark, sf, units)
    return out.select("supplier", spec_groups.key_text(F.col("kind"), F.col("key_panels")).alias("spec_key"),
                      "unit_id", F.col("qty").cast("bigint").alias("qty"),
                      F.col("n_sources").cast("bigint").alias("n_sources"), _r("confidence"),
                      _flags("flags").alias("flags"), _first("width_in").alias("width_in"))


@query
def consensus_evidence(spark, sf):
    """The same with evidence on every unit and marks on every third part only: other groups are named by their position."""
    names = F.array(*[F.lit(s) for s in cons.SOURCES])
    box = F.struct(*[(F.col("line") * k).cast("double").alias(n) for k, n in enumerate("xywh", 1)])
    units = si.line_units(spark, sf).withColumn("source", F.get(names, (F.col("line") % 4).cast("int"))).withColumns({
        "source_marks": F.when(F.col("partkey") % 3 == 0, F.col("source_marks")).otherwise(F.array().cast("array<string>")),
        "evidence": F.array(F.struct(F.col("line").cast("int").alias("page"), F.col("source").alias("region"), box.alias("bbox")))})
    groups = _supplier_groups(spark, sf, units)
    text = lambda: spec_groups.key_text(F.col("kind"), F.col("key_panels")).alias("spec_key")
    shown = cons.consensus_evidence(units, ["supplier"]).select("supplier", text(), "region", "page").groupBy("supplier", "spec_key").agg(
        F.count(F.lit(1)).alias("n_evidence"), F.count_distinct("region").alias("n_regions"), F.max("page").cast("bigint").alias("last_page"))
    return groups.select("supplier", text(), "unit_id", F.col("qty").cast("bigint").alias("qty")).join(shown, ["supplier", "spec_key"])


# -- schedules --------------------------------------------------------------------

def _table_view(units):
    return units.select("doc_id", "row_no", "unit_id", "kind", F.col("qty").cast("bigint").alias("qty"),
                        _first("width_in").alias("width_in"), _first("height_in").alias("height_in"),
                        _first("glass").alias("glass"), _first("u_factor").alias("u_factor"),
                        _first("egress").alias("egress"), "confidence")


@query
def table_units_strict(spark, sf):
    return _table_view(schedules.table_units(si.schedule_cells(spark, sf), "v1", si.schedule_documents(spark, sf)))


@query
def table_units_lenient(spark, sf):
    return _table_view(schedules.table_units(si.schedule_cells(spark, sf), "v2", si.schedule_documents(spark, sf)))


def _split_cells(spark, sf):
    """Schedule tables with a width and a height column instead of a size; some cells say something else."""
    cells = si.schedule_cells(spark, sf)
    side = lambda i: F.element_at(F.split("text", " X "), i)
    row, head = F.col("row_no"), F.col("row_no") == 0
    width = F.when(head, "Width").when(row % 4 == 0, "see plan").otherwise(side(1))
    height = F.when(head, "Height").when(row % 3 == 0, "").otherwise(side(-1))
    cell = lambda col, text: F.struct(col.alias("col_no"), text.alias("text"))
    # one pass over the cells: a size becomes two cells
    split = F.when(F.col("col_no") == 0, F.array(cell(F.col("col_no"), width), cell(F.lit(6), height))).when(
        F.col("col_no") > 0, F.array(cell(F.col("col_no"), F.col("text"))))
    return cells.withColumn("_cell", F.explode(split)).withColumns({"col_no": F.col("_cell.col_no"), "text": F.col("_cell.text")}).drop("_cell")


@query
def table_units_split(spark, sf):
    """Units of tables with width and height columns."""
    return _table_view(schedules.table_units(_split_cells(spark, sf), "v1", si.schedule_documents(spark, sf)))


@query
def table_rejects(spark, sf):
    """Rows of these tables that give no unit, with the reason."""
    return schedules.table_rejects(_split_cells(spark, sf), "v1", si.schedule_documents(spark, sf)).select(
        "doc_id", "row_no", "reject", F.size("cells").cast("bigint").alias("n_cells"))


@query
def schedule_row_units(spark, sf):
    return schedules.schedule_units(si.schedule_rows(spark, sf)).select(
        "project", "unit_id", "kind", F.col("qty").cast("bigint").alias("qty"), _first("width_in").alias("width_in"),
        _first("height_in").alias("height_in"))


@query
def schedule_row_rejects(spark, sf):
    return schedules.schedule_rejects(si.schedule_rows(spark, sf)).groupBy("size_code", "reject").agg(
        F.count(F.lit(1)).alias("n"))


@query
def schedule_gate(spark, sf):
    """Branch 2: decoded rows of reader b against reader a's units, gated per project."""
    truth = schedules.schedule_units(si.schedule_rows(spark, sf))
    return branches.schedule_branch(si.schedule_rows(spark, sf, "b"), truth, ["project"]).select(
        "project", _r("group_f1"), _r("unit_count_error"), "matched_groups", "fp_groups", "fn_groups", "gate")


@query
def reader_agreement(spark, sf):
    return comparison.agreed_rows(si.schedule_rows(spark, sf), si.schedule_rows(spark, sf, "b")).select(
        "mark", "code", F.col("qty").cast("bigint").alias("qty"), "type")


def _two_readings(spark, sf):
    return [comparison.index_by_mark(si.transcript(spark, sf, s), ["row_no"]) for s in ("a", "b")]


@query
def two_source_diff(spark, sf):
    columns = ("WINDOW SIZE", "QTY", "DAY OPEN (SF)", "VENT (SF)")
    return comparison.diff_sources(*_two_readings(spark, sf), columns)


@query
def two_source_rows(spark, sf):
    rows = comparison.diff_rows(comparison.diff_sources(*_two_readings(spark, sf)))
    return rows.select("mark", "n_diffs", F.array_join("row_diffs", "|").alias("row_diffs"))


@query
def two_source_summary(spark, sf):
    a, b = _two_readings(spark, sf)
    return comparison.diff_summary(a, b, comparison.diff_sources(a, b))


# -- rules --------------------------------------------------------------------------

@query
def rule_flags(spark, sf):
    """Every rule on augmented order-line units, with references per part."""
    units = si.line_units(spark, sf).withColumns({
        "unit_id": F.col("partkey").cast("string"),
        "sill_height_in": F.col("qty").cast("double"), "adjacent_door": F.col("linestatus") == "O",
        "room_label": F.when(F.col("returnflag") == "R", "Bedroom"),
        "facade_count": F.when(F.col("tax") > 0.03, F.col("line") * 7),
        "tempered_zone": F.col("discount") > 0.05, "tempered_required": F.col("discount") < 0.02})
    part = si.table(spark, sf, "part")
    counts = part.where("p_type = 'LARGE'").select(
        F.col("p_partkey").cast("string").alias("unit_id"), (2 + F.col("p_size") % 2).cast("int").alias("ref_panel_count"))
    sizes = part.where("p_size > 5").select(
        F.col("p_partkey").cast("string").alias("unit_id"), (20.0 + F.col("p_size")).alias("ref_width_in"),
        (40.4 + F.col("p_size")).alias("ref_height_in"))
    checked = rules.check_units(units, ["unit_id"], counts, sizes)
    return checked.select("project", "line", "unit_id", "qty", _flags("check_flags").alias("flags"))


@query
def inline_rule_flags(spark, sf):
    units = si.line_units(spark, sf)
    return units.select("project", "unit_id", _flags_of(rules.inline_rules()).alias("flags")).groupBy("flags").agg(
        F.count(F.lit(1)).alias("n"))


def _flags_of(rule_list):
    return F.array_join(F.array_sort(rules.flag_array(rule_list)), ",")


@query
def findings_by_unit(spark, sf):
    """Flags of every unit that has some, as one sorted list."""
    marked = F.array_compact(F.array(
        F.when(F.col("l_returnflag") == "R", "R"), F.when(F.col("l_tax") > 0.05, "TAX"),
        F.when(20 + F.col("p_size") + F.col("l_partkey") % 16 / F.lit(16.0) > 60, "WIDE")))
    long = si.lines_with_parts(spark, sf).select(
        F.col("l_orderkey").alias("project"), F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey").alias("unit_id"),
        F.explode(marked).alias("flag"))
    return rules.findings_by_unit(long, ["project"]).select("project", "unit_id", F.array_join("flags", ",").alias("flags"))


@query
def missing_plan_marks(spark, sf):
    """Marks used on the plan (order lines) without a schedule row (open orders only)."""
    plan = si.table(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("string").alias("mark"))
    scheduled = si.table(spark, sf, "lineitem").where("l_linestatus = 'O'").select(
        "l_orderkey", F.col("l_linenumber").cast("string").alias("unit_id"))
    return rules.missing_marks(plan, scheduled, ["l_orderkey"])


def part_defects() -> list[injection.Defect]:
    """The ten defect types, each aimed at the parts of one attribute value."""
    D, at = injection.Defect, injection.attribute
    window = lambda cond: lambda: (F.col("kind") == "window") & cond()
    size = lambda n: lambda: F.col("size") == n
    return [
        D("v01", "i01", "SIZE", rules.SIZE_MISMATCH, "wide", edit=injection.first_panel(width_in=50.0), where=window(size(3))),
        D("v02", "i02", "DOOR", rules.NEAR_DOOR_ANNEALED, "annealed",
          edit=injection.both(injection.first_panel(glass="annealed"), at(adjacent_door=True)), where=window(size(5))),
        D("v03", "i03", "BEDROOM", rules.EGRESS_UNDERSIZE, "small",
          edit=injection.both(injection.first_panel(clear_opening_sqft=4.5), at(room_label="bedroom")), where=window(size(7))),
        D("v04", "i04", "MARK", rules.MARK_MISSING, "plan only", plan_mark="none"),
        D("v05", "i05", "FACADE", rules.FACADE_MISMATCH, "count", edit=at(facade_count=30), where=window(size(9))),
        D("v06", "i06", "SILL", rules.LOW_SILL_ANNEALED, "low",
          edit=injection.both(injection.first_panel(glass="annealed"), at(sill_height_in=12.0)), where=window(size(11))),
        D("v07", "i07", "UFACTOR", rules.UFACTOR_BREACH, "high", edit=injection.first_panel(u_factor=0.30), where=window(size(13))),
        D("v08", "i08", "PANELS", rules.PANEL_COUNT, "dropped", edit=injection.keep_panels(1),
          where=lambda: (F.col("kind") == "composite") & (F.col("size") < 10)),
        D("v09", "i09", "CONFLICT", rules.TEMPERED_CONFLICT, "conflict",
          edit=injection.both(injection.first_panel(egress=True, glass="annealed"), at(tempered_required=True)),
          where=window(size(15))),
        D("v10", "i10", "ZONE", rules.ZONE_WITHOUT_GLASS, "no glass",
          edit=injection.both(injection.first_panel(glass=None), at(tempered_zone=True)), where=window(size(17))),
    ]


def _injected(spark, sf):
    scope = ["project", "variant_id"]
    units = si.part_units(spark, sf)
    chosen = part_defects()
    variants = injection.inject(units, chosen)
    counts, sizes = injection.baseline_of(units, ["unit_id"])
    checked = rules.check_units(variants, ["unit_id"], counts, sizes)
    marks = rules.missing_marks(injection.plan_marks(variants, ["project"], chosen),
                                variants.select(*scope, "unit_id"), scope)
    found = rules.findings(checked, scope, marks)
    return metrics.score_flags(found, injection.injections(variants, ["project"], chosen), scope)


@query
def inject_score(spark, sf):
    """Known defects in every part, found again by the rules; per brand and variant."""
    return _injected(spark, sf).select("project", "variant_id", "caught", "missed", "false_flags",
                                       _r("recall"), _r("precision"))


@query
def inject_mean(spark, sf):
    return metrics.mean_flag_scores(_injected(spark, sf), ["variant_id"]).select(
        "variant_id", _r("error_recall"), _r("error_precision"), "n_variants")


# -- data quality ----------------------------------------------------------------------

def _quality_units(spark, sf):
    rows = si.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("string").alias("mark"),
        F.when((F.col("l_returnflag") != "N") | (F.col("l_linestatus") != "F"), F.col("l_quantity")).alias("qty"),
        F.when(F.col("l_tax") == 0.01, "vlm_read").when(F.col("l_tax") == 0.02, "unknown").alias("qty_source"),
        F.when(F.col("l_discount") > 0, F.col("l_extendedprice") / 100).otherwise(0.0).alias("width"),
        (F.col("l_quantity") * 13).alias("height"))
    return quality.unit_findings(quality.stamp_qty_source(rows, "schedule_column"))


@query
def dq_scan(spark, sf):
    lines = offers.check_lines(si.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.lit(2.0).alias("unit_price"), F.col("l_quantity").alias("qty"),
        (F.col("l_quantity") * 2 + F.when(F.col("l_linenumber") == 7, 1.0).otherwise(0.0)).alias("line_total")))
    unscored = si.table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("doc_id"))
    return quality.quality_summary(_quality_units(spark, sf), ["doc_id"], lines, unscored)


@query
def dq_findings(spark, sf):
    return quality.long_findings(_quality_units(spark, sf), ["doc_id"]).groupBy("mark", "severity", "rule").agg(
        F.count(F.lit(1)).alias("n"))


# -- run results -------------------------------------------------------------------------

def _board(spark, sf):
    return lb.latest_wins(si.runs(spark, sf), ["mtime", "event_id"])


_FIGURES = ["group_f1", "unit_count_error", "qty_mae", "cost_usd"]


@query
def latest_wins(spark, sf):
    return _board(spark, sf).select(*lb.KEYS, *[_r(c) for c in _FIGURES], "error", "event_id")


@query
def winner(spark, sf):
    board = _board(spark, sf)
    won = lb.winners(board, ["project", "gt_level"], tiebreak=["event_id"])
    return lb.tag_winners(board, won).groupBy("project", "gt_level").agg(
        F.max(F.when(F.col("is_winner"), F.col("variant"))).alias("variant"),
        F.max(F.when(F.col("is_winner"), F.col("model"))).alias("model"),
        _r(F.max(F.when(F.col("is_winner"), F.col("group_f1")))).alias("group_f1"),
        F.count_if("is_winner").alias("n_winners"), F.count(F.lit(1)).alias("n_rows"))


@query
def best_row(spark, sf):
    return lb.best_by_f1(_board(spark, sf), "p3").select(*lb.KEYS, _r("group_f1"))


@query
def gate(spark, sf):
    """All seven limits."""
    runs = si.runs(spark, sf).withColumns({
        "egress_acc": F.when(F.col("event_id") % 3 != 0, 1 - F.col("unit_count_error")),
        "hallucination_rate": F.col("unit_count_error") / 2, "error_recall": F.col("group_f1")})
    gated = lb.gate(runs)
    return gated.select("event_id", "gate_pass", F.array_join("gate_reasons", "; ").alias("reasons"))


@query
def gate_counts(spark, sf):
    return lb.gate_counts(_board(spark, sf), ["project", "gt_level"])


@query
def strategy_summary(spark, sf):
    return lb.strategy_summary(_board(spark, sf).where("gt_level = 'extraction'"), ["project"]).select(
        "project", "variant", "cells", "n_pass", "n_fail", _r("pass_pct"), _r("best_group_f1"), _r("min_cost_usd"))


@query
def title_facts(spark, sf):
    return lb.title_facts(_board(spark, sf)).withColumn("best_f1", _r("best_f1"))


@query
def round_delta(spark, sf):
    """Afternoon runs against morning runs, on differently named columns."""
    runs = si.runs(spark, sf)
    late = F.hour("mtime") >= 12
    before = runs.where(~late).withColumnRenamed("group_f1", "ext_group_f1")
    now = lb.latest_wins(runs.where(late), ["mtime", "event_id"])
    return lb.round_delta(now, before, ["mtime", "event_id"], {"ext_group_f1": "group_f1"}).select(
        "variant", "model", "project", *[_r(c) for c in ("f1_now", "f1_before", "f1_change", "uce_change")])


@query
def budget_cap(spark, sf):
    """Runs in time order until the spending of their model reaches the cap, and over all runs."""
    cells = si.runs(spark, sf).select("event_id", "model", F.round("cost_usd", 4).alias("cost_usd"))
    capped = lb.within_budget(cells, ["event_id"], 100.0, ["model"])
    return capped.select("event_id", "model", _r(F.col("spent_before").cast("double"), 4).alias("spent_before"), "runs")


@query
def budget_markers(spark, sf):
    """Per model the first run that the budget stopped."""
    cells = si.runs(spark, sf).select("event_id", "model", F.round("cost_usd", 4).alias("cost_usd"))
    found = lb.budget_markers(lb.within_budget(cells, ["event_id"], 100.0, ["model"]), ["event_id"], ["model"])
    return found.withColumn("spent", _r(F.col("spent").cast("double"), 4))


@query
def variants_round_trip(spark, sf):
    """Units of five variants, written by variant and read back."""
    path = staged_path(spark, "variants")
    units = si.line_units(spark, sf).select(
        F.concat(F.lit("v"), (F.col("partkey") % 5).cast("string")).alias("variant_id"), "unit_id", "kind", "qty")
    us.write_variants(units, path)
    return spark.read.json(path).groupBy("variant_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("qty").alias("qty"))


@query
def report_round_trip(spark, sf):
    """Result rows written as a dated, versioned report and read back."""
    path = staged_path(spark, "report")
    us.write_report(si.runs(spark, sf).select("variant", "group_f1"), path, "r1")
    return spark.read.json(path).groupBy("version", "variant").agg(
        F.count(F.lit(1)).alias("n"), _r(F.sum("group_f1"), 4).alias("f1"), F.bool_and(F.col("generated").isNotNull()).alias("dated"))


@query
def leaderboard_round_trip(spark, sf):
    """The leaderboard as a CSV with named columns, read back by them."""
    path = staged_path(spark, "board")
    lcsv.write_leaderboard(_board(spark, sf).select(*lb.KEYS, "group_f1", "cost_usd"), path)
    back = spark.read.option("header", True).csv(path)
    return back.select(*lb.KEYS, *[_r(F.col(c).cast("double")).alias(c) for c in ("group_f1", "cost_usd")])


@query
def order_overlaps(spark, sf):
    """Does a returned line's box overlap another line's box of its order?"""
    b = ge.box(F.col("l_partkey") % 40 * 25, F.col("l_linenumber") * 40, 60 + F.col("p_size"), 80 + F.col("p_size") % 7)
    boxes = si.lines_with_parts(spark, sf).select("l_orderkey", "l_returnflag", b.alias("b"))
    of = lambda c: F.collect_list(F.when(c, F.col("b")))  # an order has few lines
    returned = F.col("l_returnflag") == "R"
    return boxes.groupBy(F.col("l_orderkey").alias("doc_id")).agg(
        ge.any_overlap(of(returned), of(~returned)).alias("overlaps"))


@query
def budget_cap_total(spark, sf):
    """One budget over all runs."""
    cells = si.runs(spark, sf).select("event_id", "model", F.round("cost_usd", 4).alias("cost_usd"))
    capped = lb.within_budget(cells, ["event_id"], 500.0)
    return capped.select("event_id", _r(F.col("spent_before").cast("double"), 4).alias("spent_before"), "runs")


@query
def run_cells(spark, sf):
    """Rounded figures, percentages and clipped titles of all runs."""
    runs = lb.base_row(si.runs(spark, sf))
    title = F.concat_ws(" ", F.lit("run of"), "variant", F.lit("on"), "project", F.lit("with"), "model")
    return runs.select("event_id", tx.format_percent_cell(F.col("glass_acc")).alias("glass_pct"),
                       tx.clip_text(title, 16).alias("title"), "elapsed_sec", "cost_usd")


@query
def missing_cells(spark, sf):
    return lb.missing_cells(spark, list("ABCDEFGH"), ["click", "view", "signup", "gpt"],
                            [f"p{i}" for i in range(12)], si.runs(spark, sf))


@query
def report_table(spark, sf):
    return lb.report_table(_board(spark, sf)).select(*lb.KEYS, *_FIGURES, "glass_acc", "elapsed_sec", "error")


@query
def run_totals(spark, sf):
    runs = si.runs(spark, sf)
    calls = runs.select("variant", "model", F.when(F.col("model") != "view", F.col("cost_usd")).alias("cost_usd"), "error")
    units = runs.select("variant", "model", F.col("event_id").alias("qty")).where("variant <> 'G'")
    return lb.run_totals(units, calls, ["variant", "model"]).withColumn("cost_usd", F.round("cost_usd", 4))


@query
def branch_results(spark, sf):
    """Routed documents through the four branches: offers, schedules against a truth without every third row, sheets, sampled pages."""
    pages = si.document_pages(spark, sf)
    routed = stage(routing.classify(routing.route_signals(pages, si.page_votes(spark, sf, pages))), "routes")
    content = si.branch_pages(spark, sf)
    truth = schedules.schedule_units(content.select("doc_id", F.inline("rows")).where("cast(substr(mark, 2) as bigint) % 3 != 0"))
    return branches.branch_results(routed, branches.run_branches(routed, content, truth)).select(
        "doc_id", F.col("branch").cast("bigint").alias("branch"), "branch_name", "n_units", "n_errors", "n_warnings", "ok", "total_qty",
        "reconciled", "offer_lines", "scored", _r("group_f1"), "gate", "confidence")


@query
def elevation_reads(spark, sf):
    """Branch 3: page reads of the densest sheets per source."""
    pages = si.elevation_text_pages(spark, sf)
    raw = F.concat(F.lit('{"units":['), F.when(F.col("page_no") % 3 == 0, "").otherwise('{"mark":"E","qty":2}'),
                   F.lit('],"readable":'), F.when(F.col("page_no") % 2 == 0, "true").otherwise("false"), F.lit("}"))
    reads = branches.elevation_branch(pages, pages.select("doc_id", "page_no", raw.alias("raw_text")))
    return branches.read_summary(reads).select("doc_id", "page_no", "confidence", "readable",
                                               F.col("n_units").cast("bigint").alias("n_units"))


@query
def handwritten_reads(spark, sf):
    """Branch 4: page reads of three sampled pages per conversation; prose is not readable."""
    pages = si.table(spark, sf, "conversations").select(
        F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("page_no"), "text", "role")
    raw = F.when(F.col("role") == "user", F.lit('{"units":[{"mark":"A","width_in":30}],"confidence":"medium","readable":true}')
                 ).otherwise(F.translate("text", "{}", ""))
    reads = branches.handwritten_branch(pages, pages.select("doc_id", "page_no", raw.alias("raw_text")))
    return branches.read_summary(reads).select("doc_id", "page_no", "confidence", "readable",
                                               F.col("n_units").cast("bigint").alias("n_units"))


@query
def strategy_registry(spark, sf):
    """All registered strategies over the same drawings: number of units and total quantity."""
    drawing = _drawing(spark, sf)
    # a page is short and its answers take long to read, so pages are dealt out before they are answered
    asked = drawing["pages"].repartition(4 * spark.sparkContext.defaultParallelism, "doc_id", "page_no")
    answered = si.crop_responses(asked)
    whole = answered.where("region_no = 1").withColumn("region_no", F.lit(0))
    crops = stage(strategies.numbered_regions(drawing["regions"], drawing["pages"]), "crops")
    # all strategies but the last get the same responses: they are read once
    tables = {**drawing, "units": stage(strategies.response_units(answered.unionByName(whole)), "units"), "crops": crops,
              "coarse": si.coarse_responses(asked), "table_cells": si.schedule_cells(spark, sf),
              "table_documents": si.schedule_documents(spark, sf)}
    agents = {**drawing, "crops": crops, "responses": si.crop_responses(asked, sources=True)}
    rows = None
    for letter, strategy in strategies.STRATEGIES.items():
        units = strategy(agents if letter == "F" else tables)
        total = units.agg(F.lit(letter).alias("letter"), F.count(F.lit(1)).alias("n_units"), F.sum(F.col("qty").cast("bigint")).alias("qty"))
        rows = total if rows is None else rows.unionByName(total)
    return rows


# -- review, inventory, files and streams ---------------------------------------------------

@query
def unit_review(spark, sf):
    flags = F.array_compact(F.array(F.when(F.col("returnflag") == "R", "r"), F.when(F.col("linestatus") == "O", "o")))
    units = si.line_units(spark, sf).withColumns({
        "confidence": 0.5 + F.col("discount"), "flags": flags, "discovery_gaps": F.array().cast("array<string>")})
    return review.unit_review(units).groupBy("size", "conf", "flags_text", "gaps_text").agg(F.count(F.lit(1)).alias("n"))


@query
def page_boxes(spark, sf):
    units = si.boxed_units(spark, sf)
    pages = si.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("doc_id"), F.col("l_linenumber").cast("bigint").alias("page_no")).distinct()
    return review.page_boxes(units, pages).select("doc_id", "page_no", "unit_id", "label", "x", "y", "w", "h")


@query
def document_inventory(spark, sf):
    expected = si.table(spark, sf, "events").select(F.col("event_id").cast("string").alias("name"))
    files = si.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("name"),
                                                    F.col("n_chars").alias("n_bytes"))
    return inv.inventory(expected, files, 5000)


@query
def units_jsonl_round_trip(spark, sf):
    """Units written as partitioned JSON lines and read back."""
    path = staged_path(spark, "units")
    units = si.line_units(spark, sf).withColumns({"model": F.concat(F.lit("m:"), "returnflag"), "variant": F.lit("a")})
    us.write_units(units, path, ["variant", "model"])
    back = us.read_units(spark, path)
    return back.groupBy("model", "kind").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("qty").cast("bigint")).alias("qty"),
        F.count_if(F.col("reject").isNotNull()).alias("rejects"),
        F.sum(F.size("panels")).cast("bigint").alias("panels"), F.sum(_first("width_in")).alias("width_sum"),
        F.min("confidence").alias("confidence"))


@query
def truth_files(spark, sf):
    """Truth of projects of fifty parts at two levels, written as one file per project and read back."""
    path, read = staged_path(spark, "truth"), None
    number = F.floor(F.col("unit_id").cast("bigint") / 50).cast("string")
    units = si.part_units(spark, sf).select(F.concat(F.lit("p"), number).alias("project"), "unit_id", "kind", "panels", "qty")
    for level, part in (("extraction", units), ("offer", units.where("kind != 'door'"))):
        totals = F.struct(F.sum("qty").cast("int").alias("units"), F.sum(F.col("qty") * F.size("panels")).cast("int").alias("frames"))
        files = part.groupBy("project").agg(totals.alias("totals"), F.collect_list(F.struct("unit_id", "kind", "panels", "qty")).alias("units"))
        files.withColumn("level", F.lit(level)).write.option("maxRecordsPerFile", 1).json(f"{path}/{level}")
        rows = us.read_truth(spark, f"{path}/{level}", level)
        read = rows if read is None else read.unionByName(rows)
    return read.groupBy("project", "gt_level").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("qty").cast("bigint")).alias("qty"), F.max("true_frames").alias("true_frames"),
        F.sum(_first("width_in")).alias("width_sum"), F.min("confidence").alias("confidence"))


@query
def transcript_files(spark, sf):
    """Two transcripts of schedules, one file per two hundred orders and reader, read back cell by cell."""
    path, read = staged_path(spark, "transcripts"), None
    for source in ("a", "b"):
        rows = si.transcript(spark, sf, source)
        files = rows.groupBy(F.floor(F.col("row_no") / 200).alias("file")).agg(F.collect_list("cells").alias("window_schedule"))
        files.select("window_schedule").write.option("maxRecordsPerFile", 1).json(f"{path}/{source}")
        back = us.read_transcript(spark, f"{path}/{source}", source)
        read = back if read is None else read.unionByName(back)
    return read.select("source", F.explode("cells").alias("heading", "text")).groupBy("source", "heading").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).cast("bigint").alias("chars"))


@query
def csv_partial_merge(spark, sf):
    """Partial leaderboards with different headers and common keys, merged: the later file wins."""
    path = staged_path(spark, "boards")
    runs = si.runs(spark, sf).drop("elapsed_sec")
    for half, dropped in (("early", ["glass_acc", "mtime"]), ("late", ["error", "qty_mae", "mtime"])):
        side = F.hour("mtime") < 12 if half == "early" else F.hour("mtime") >= 12
        rows = lb.latest_wins(runs.where(side), ["event_id"]).drop(*dropped)
        lcsv.write_partials(rows, f"{path}/{half}")
    merged = lcsv.merge_leaderboards(spark, path)
    return merged.select(*lb.KEYS, *[_r(c) for c in (*_FIGURES, "glass_acc")], "error")


def _event_stream(spark, sf):
    schema = si.table(spark, sf, "events").schema
    stream = ingest.watch_table(spark, sf, schema, "parquet", "events.parquet")
    return stream.withColumns({"ts": F.col("ts").cast("timestamp"), "name": F.concat_ws("-", "event_type", "user_id"), "size": F.get_json_object("props", "$.k")})


@query
def stream_ingest_dedup(spark, sf):
    """Events as a file stream, one row per (name, size), run twice on one checkpoint."""
    sink, checkpoint = staged_path(spark, "sink"), staged_path(spark, "offsets")
    for _ in range(2):
        ingest.for_each_batch(_event_stream(spark, sf), checkpoint, ingest.append_new(sink, ["name", "size"], ["ts", "event_id"]))
    return spark.read.parquet(sink).select("name", "size", "event_type", "user_id", "event_id")


@query
def stream_merge_latest(spark, sf):
    """Newest run per key, merged batch by batch from a stream of three files."""
    root, checkpoint = staged_path(spark, "merged"), staged_path(spark, "offsets")
    merge = merged.merge_batch(root, ["ts", "event_id"], ["user_id", "event_type"])
    ingest.for_each_batch(_event_files(spark, sf), checkpoint, merge)
    return merged.read_current(spark, root).select("user_id", "event_type", "event_id", "value")


def _event_files(spark, sf):
    """Events as a stream of three files, one batch each."""
    path, events = staged_path(spark, "files"), si.table(spark, sf, "events")
    for k in range(3):
        events.where(F.pmod("event_id", F.lit(3)) == k).coalesce(1).write.mode("append").parquet(path)
    stream = ingest.watch_table(spark, path, events.schema, "parquet", "*.parquet", max_files=1)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


@query
def stream_indexed_sink(spark, sf):
    """First event per user and type among three batches, the last two run twice; filters pick the files to be read."""
    sink = staged_path(spark, "sink")
    append = merged.append_new_indexed(sink, ["user_id", "event_type"], ["ts", "event_id"], buckets=16)
    events = si.table(spark, sf, "events")
    for k in (0, 1, 1, 2, 2):
        append(events.where(F.pmod("event_id", F.lit(3)) == k), k)
    return merged.read_indexed(spark, sink).select("user_id", "event_type", "event_id", "value")


@query
def stream_status(spark, sf):
    """Rows per batch, as a listener wrote them while the stream ran."""
    path, checkpoint, sink = (staged_path(spark, n) for n in ("status", "offsets", "sink"))
    listener = ingest.StatusTable(path)
    spark.streams.addListener(listener)
    try:
        ingest.for_each_batch(_event_files(spark, sf), checkpoint, lambda batch, _: batch.write.mode("append").parquet(sink))
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()  # the last batch is reported after the query has ended
    finally:
        spark.streams.removeListener(listener)
    return spark.read.parquet(path).where("rows_in > 0").select("batch_id", "rows_in")


@query
def chat_attachments(spark, sf):
    """Files sent by one user among chat messages, in two polls with the message number carried on; repeats are skipped."""
    k, kind = F.col("event_id"), F.col("event_type")
    file = F.when(kind != "view", F.struct(
        F.concat(F.lit("id"), k.cast("string"), F.lit("-long")).alias("file_id"),
        F.when(k % 5 != 0, F.concat_ws(".", kind, F.get_json_object("props", "$.k"), F.lit("pdf"))).alias("file_name"),
        F.when(k % 7 != 0, F.get_json_object("props", "$.k").cast("bigint") % 4).alias("file_size")))
    sender = lambda c: F.struct(c.alias("id"))
    message = F.struct(sender(F.col("user_id") % 10).alias("from"), sender(F.lit(77)).alias("chat"), file.alias("document"))
    path, checkpoint, sink = (staged_path(spark, n) for n in ("chat", "offsets", "sink"))
    events = si.table(spark, sf, "events").select(k.alias("update_id"), F.when(k % 3 != 0, message).alias("message"),
                                                  F.when(k % 3 == 0, message).alias("channel_post"))
    seen, half = None, events.agg(F.expr("(min(update_id) + max(update_id)) div 2")).first()[0]
    append = merged.append_new_indexed(sink, ["name", "size"], ["update_id"], buckets=16)
    for upto in (F.col("update_id") <= half, F.lit(True)):  # the second poll sees the first messages again
        events.where(upto).write.mode("overwrite").json(path)
        updates = spark.read.schema(ingest.CHAT_UPDATE).json(path)
        append(ingest.chat_files(updates, 3, seen), 0 if seen is None else 1)
        seen = ingest.next_offset(updates)
    return merged.read_indexed(spark, sink).select("update_id", "name", "size")


@query
def run_commits(spark, sf):
    """Units, log and raw text of three batches of responses, of which one is lost half way and run again, and one repeated."""
    root = staged_path(spark, "run")
    responses = si.unit_responses(spark, sf).withColumn("error", F.when(F.col("doc_id") % 7 == 0, "timeout"))
    part = lambda k: responses.where(F.col("page_no") % 3 == k)

    def lost(batch):
        tables = run_files.run_tables(batch)
        return {**tables, "raw": tables["raw"].withColumn("raw_text", F.raise_error(F.lit("executor lost")).cast("string"))}

    record = run_files.record_run(root)
    record(part(0), 0)
    try:
        run_files.write_together(root, lost)(part(1), 1)
        raise AssertionError("the batch was to fail")
    except PySparkException:
        pass
    for k in (1, 2, 0):
        record(part(k), k)
    count = lambda name: run_files.run_table(spark, root, name).groupBy("page_no").agg(F.count(F.lit(1)).alias(f"n_{name}"))
    failed = run_files.run_table(spark, root, "log").groupBy("page_no").agg(F.count("error").alias("n_failed"))
    return count("log").join(failed, "page_no").join(count("raw"), "page_no", "left").join(count("units"), "page_no", "left")


@query
def incremental_append(spark, sf):
    """Order lines processed in two overlapping requests; each key is appended once."""
    path = staged_path(spark, "done")
    lines = si.table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.sum(F.col("l_quantity").cast("bigint")).alias("qty"), F.max("l_linestatus").alias("status"))
    for part in (lines.where("status = 'O'"), lines):
        incremental.append_pending(part, path, ["l_orderkey", "l_linenumber"])
    return spark.read.parquet(path).groupBy("l_linenumber", "status").agg(
        F.count(F.lit(1)).alias("n"), F.sum("qty").alias("qty"))
