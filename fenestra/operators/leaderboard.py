"""Run results: merge, rank, gate, summarise and compare."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from fenestra.functions.text import DASH, fixed, format_dollar_cell, format_number_cell
from fenestra.operators.ordered import running_totals
from fenestra.schemas import LEADERBOARD

# fixed values: result keys, gates and the strategies always shown
KEYS = ["variant", "model", "project", "gt_level"]
GATE = {"unit_count_error": ("<=", 0.05), "group_f1": (">=", 0.90), "qty_mae": ("<=", 1.0),
        "glass_acc": (">=", 0.95), "egress_acc": (">=", 0.95), "hallucination_rate": ("<=", 0.05),
        "error_recall": (">=", 0.80)}
SHORT_GATE_F1, SHORT_GATE_ERROR = 0.70, 0.05
WINNER_MAX_ERROR = 0.05
STRATEGIES = ("A", "B", "C", "D", "E", "F")
WILDCARD = "*"


def typed(rows: DataFrame) -> DataFrame:
    """Text columns of a merged CSV under their declared types; unreadable text becomes NULL."""
    return rows.select(*[F.nullif(F.col(c), F.lit("")).try_cast(LEADERBOARD[c]).alias(c)
                         if LEADERBOARD.get(c, "string") != "string" else F.col(c) for c in rows.columns])


def latest_wins(rows: DataFrame, recency: list[str], keys: list[str] | None = None) -> DataFrame:
    """Newest row per key by ``recency`` columns.

    A maximum per key, so a key with most of the rows shrinks before the shuffle.
    """
    keys = keys or KEYS
    rest = [c for c in rows.columns if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*recency)).alias("_r"))
    return newest.select(*keys, "_r.*")


def base_row(runs: DataFrame) -> DataFrame:
    """Rounded time and cost of a run."""
    return runs.withColumn("elapsed_sec", F.round("elapsed_sec", 2)).withColumn(
        "cost_usd", F.round("cost_usd", 4))


def run_totals(units: DataFrame, responses: DataFrame, scope: list[str]) -> DataFrame:
    """Units, cost, unpriced responses and errors per run."""
    spent = responses.groupBy(*scope).agg(
        F.sum("cost_usd").alias("cost_usd"), F.count_if(F.col("cost_usd").isNull()).alias("unpriced_rows"),
        F.count("error").alias("errors_count"))
    made = units.groupBy(*scope).agg(F.sum(F.col("qty").cast("bigint")).alias("n_units"))
    return spent.join(made, scope, "full_outer").withColumn("n_units", F.coalesce("n_units", F.lit(0)))


def _better() -> Column:
    """Sort value of a row: higher F1, then lower quantity error, then lower cost; unknown is worst."""
    worst = F.lit(float("inf"))
    return F.struct((-F.coalesce("group_f1", F.lit(0.0))).alias("f"), F.coalesce("qty_mae", worst).alias("q"),
                    F.coalesce("cost_usd", worst).alias("c"), "variant", "model")


def winners(rows: DataFrame, scope: list[str], max_error: float = WINNER_MAX_ERROR,
            tiebreak: list[str] | None = None) -> DataFrame:
    """Best row per scope among rows whose unit count error is known and small enough."""
    fits = rows.where(F.col("unit_count_error") <= max_error)
    order = F.struct(_better().alias("b"), *(tiebreak or []))
    return fits.groupBy(*scope).agg(F.min_by(F.struct(*[c for c in rows.columns if c not in scope]), order)
                                    .alias("_r")).select(*scope, "_r.*")


def pick_winner(rows: DataFrame, project: str, gt_level: str = "extraction",
                max_error: float = WINNER_MAX_ERROR, tiebreak: list[str] | None = None) -> DataFrame:
    """The winning row of one project and level; empty when nothing qualifies."""
    there = rows.where((F.col("project") == project) & (F.col("gt_level") == gt_level))
    return winners(there, ["project", "gt_level"], max_error, tiebreak)


def best_by_f1(rows: DataFrame, project: str) -> DataFrame:
    """Best F1 of a project among rows without an error."""
    clean = rows.where((F.col("project") == project) & (F.coalesce("error", F.lit("")) == ""))
    return clean.orderBy(F.coalesce("group_f1", F.lit(0.0)).desc(), *KEYS).limit(1)


def tag_winners(rows: DataFrame, won: DataFrame) -> DataFrame:
    """Add ``is_winner``, matched on the result keys."""
    marks = won.select(*KEYS).distinct().withColumn("_w", F.lit(True))
    return rows.join(marks, KEYS, "left").withColumn("is_winner", F.coalesce("_w", F.lit(False))).drop("_w")


def gate(rows: DataFrame, limits: dict[str, tuple[str, float]] | None = None) -> DataFrame:
    """Add ``gate_reasons`` (at most one per metric) and ``gate_pass``; a missing metric fails."""
    def reason(name: str, op: str, limit: float) -> Column:
        v = F.col(name).try_cast("double")
        fails, sign = (v > limit, ">") if op == "<=" else (v < limit, "<")
        return (F.when(F.col(name).isNull(), F.lit(f"{name}: NO DATA"))
                .when(v.isNull(), F.lit(f"{name}: bad type"))
                .when(fails, F.concat(F.lit(f"{name}="), fixed(v, 3), F.lit(f" {sign} {limit}"))))

    checks = GATE if limits is None else limits
    absent = {n: F.lit(None).cast("double") for n in checks if n not in rows.columns}
    rows = rows.withColumns(absent) if absent else rows
    return rows.withColumn("gate_reasons", F.array_compact(F.array(
        *[reason(n, *rule) for n, rule in checks.items()]))).withColumn(
        "gate_pass", F.size("gate_reasons") == 0)


def short_gate(rows: DataFrame, f1: float = SHORT_GATE_F1, error: float = SHORT_GATE_ERROR) -> DataFrame:
    """Add ``gate``: PASS, FAIL, or a dash where a figure is missing."""
    a, b = F.col("group_f1").try_cast("double"), F.col("unit_count_error").try_cast("double")
    return rows.withColumn("gate", F.when(a.isNull() | b.isNull(), F.lit(DASH)).when(
        (a >= f1) & (b <= error), F.lit("PASS")).otherwise(F.lit("FAIL")))


def gate_counts(rows: DataFrame, scope: list[str]) -> DataFrame:
    """Cells that pass and fail per scope."""
    return short_gate(rows).groupBy(*scope).agg(
        F.count(F.lit(1)).alias("cells"), F.count_if(F.col("gate") == "PASS").alias("n_pass"),
        F.count_if(F.col("gate") == "FAIL").alias("n_fail"))


def strategy_summary(rows: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Cells, passes, best F1 and least cost per strategy; the fixed ones always appear."""
    scope = scope or []
    real = short_gate(rows.where((F.col("variant") != WILDCARD) & (F.col("variant") != "")))
    sums = real.groupBy(*scope, "variant").agg(
        F.count(F.lit(1)).alias("cells"), F.count_if(F.col("gate") == "PASS").alias("n_pass"),
        F.count_if(F.col("gate") == "FAIL").alias("n_fail"), F.max("group_f1").alias("best_group_f1"),
        F.min("cost_usd").alias("min_cost_usd"))
    fixed = sums.select(*scope).distinct() if scope else rows.sparkSession.range(1).select()
    fixed = fixed.select(*scope, F.explode(F.array(*[F.lit(s) for s in STRATEGIES])).alias("variant"))
    domain = fixed.unionByName(sums.select(*scope, "variant")).distinct()
    return domain.join(sums, [*scope, "variant"], "left").withColumn(
        "cells", F.coalesce("cells", F.lit(0))).withColumn(
        "pass_pct", F.try_divide(F.col("n_pass") * 100.0, "cells"))


def title_facts(rows: DataFrame) -> DataFrame:
    """Row count, numbers of models and projects, the strategies and levels, and the best extraction row, as one row.

    Strategies and levels come from short fixed lists; models and projects do not, and are counted.
    """
    named = lambda c: F.count_distinct(F.when((F.col(c) != WILDCARD) & (F.col(c) != ""), F.col(c)))
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(
        F.when((F.col(c) != WILDCARD) & (F.col(c) != ""), F.col(c)))), ",")
    clean = (F.col("gt_level") == "extraction") & (F.coalesce("error", F.lit("")) == "")
    rank = F.when(clean, F.struct((-F.coalesce("group_f1", F.lit(0.0))).alias("f"), *KEYS))
    best = F.min_by(F.struct(*KEYS, "group_f1"), rank)
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), listed("variant").alias("variants"),
                    named("model").alias("n_models"), named("project").alias("n_projects"),
                    listed("gt_level").alias("levels"), best["variant"].alias("best_variant"),
                    best["model"].alias("best_model"), best["project"].alias("best_project"), best["group_f1"].alias("best_f1"))


def round_delta(now: DataFrame, before: DataFrame, recency: list[str],
                renames: dict[str, str] | None = None) -> DataFrame:
    """Change of F1 and count error against an earlier round on (variant, model, project).

    ``renames`` maps the earlier round's column names; a figure that is missing
    gives a NULL change, not a change from zero. Of repeated earlier keys the last
    one by ``recency`` counts.
    """
    keys = ["variant", "model", "project"]
    for old, new in (renames or {}).items():
        before = before.withColumnRenamed(old, new)
    last = latest_wins(before.select(*keys, "group_f1", "unit_count_error", *[
        c for c in recency if c not in ("group_f1", "unit_count_error")]), recency, keys)
    old = last.select(*keys, F.col("group_f1").alias("f1_before"), F.col("unit_count_error").alias("uce_before"))
    kept = now.where(F.col("gt_level").isNull() | (F.col("gt_level") == "extraction"))
    return kept.join(old, keys).select(
        *keys, F.col("group_f1").alias("f1_now"), "f1_before",
        (F.col("group_f1") - F.col("f1_before")).alias("f1_change"),
        F.col("unit_count_error").alias("uce_now"), "uce_before",
        (F.col("unit_count_error") - F.col("uce_before")).alias("uce_change"))


def within_budget(costs: DataFrame, order: list[str], cap: float, scope: list[str] | None = None,
                  **options) -> DataFrame:
    """Add ``spent_before`` and ``runs``: does the cell still start before the cap is reached?

    Money is added as decimals so that the cut does not depend on the order of
    additions. A cap of 0 means no cap.
    """
    money = F.coalesce(F.col("cost_usd"), F.lit(0)).cast("decimal(18,4)")
    out = running_totals(costs, scope or [], [F.col(c) for c in order], money, "spent_before", **options)
    runs = F.lit(True) if not cap else F.col("spent_before") < F.lit(cap).cast("decimal(18,4)")
    return out.withColumn("runs", runs)


def budget_markers(capped: DataFrame, order: list[str], scope: list[str] | None = None) -> DataFrame:
    """One row per scope whose cap was hit: the first cell that did not run, and what was spent before it."""
    stopped = capped.where(~F.col("runs"))
    first = F.min(F.struct(*order, "spent_before")).alias("_m")
    found = stopped.groupBy(*(scope or [])).agg(first, F.count(F.lit(1)).alias("n_skipped")).where("_m is not null")
    return found.select(*(scope or []), *[F.col(f"_m.{c}").alias(c) for c in order], F.col("_m.spent_before").alias("spent"), "n_skipped")


def missing_cells(spark, variants: list[str], models: list[str], projects: list[str],
                  rows: DataFrame) -> DataFrame:
    """Cells of the requested grid without a row yet."""
    lists = {"variant": variants, "model": models, "project": projects}
    grid = reduce(lambda df, kv: df.withColumn(kv[0], F.explode(F.array(*[F.lit(x) for x in kv[1]]))),
                  lists.items(), spark.range(1)).drop("id")
    return grid.join(rows, list(lists), "left_anti")


def report_table(rows: DataFrame) -> DataFrame:
    """Leaderboard in report order, with formatted cells."""
    shown = {c: format_number_cell(F.col(c)) for c in ("group_f1", "qty_mae", "unit_count_error", "glass_acc")}
    shown["cost_usd"] = format_dollar_cell(F.col("cost_usd"))
    shown["elapsed_sec"] = format_number_cell(F.col("elapsed_sec"), 1)
    message = F.coalesce("error", F.lit(""))
    shown["error"] = F.when(message == "", F.lit(DASH)).when(
        F.length(message) > 80, F.concat(F.substring(message, 1, 80), F.lit("..."))).otherwise(message)
    order = [F.coalesce(F.col(c), F.lit("")) for c in ("project", "gt_level", "variant", "model")]
    return rows.orderBy(*order).withColumns(shown)
