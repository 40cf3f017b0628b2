"""Scores of matched spec groups, gap lists and raised flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _count(status: str) -> Column:
    return F.count_if(F.col("status") == status)


def _field(name: str) -> tuple[Column, Column]:
    """(panels with a true value, panels where both agree) of one match."""
    pairs = F.when(F.col("status") == "matched", F.arrays_zip("pred_panels", "true_panels"))
    known = F.filter(pairs, lambda z: z["true_panels"][name].isNotNull())
    same = F.filter(known, lambda z: z["pred_panels"][name].eqNullSafe(z["true_panels"][name]))
    size = lambda a: F.greatest(F.size(a), F.lit(0))
    return F.sum(size(known)), F.sum(size(same))


def ratio(num: Column, den: Column) -> Column:
    """``num / den`` with 0 for an empty denominator, NULL for an unknown one."""
    return F.when(den > 0, num / den).when(den.isNotNull(), F.lit(0.0))


def score_matches(matches: DataFrame, scope: list[str], frames: DataFrame | None = None,
                  truth: DataFrame | None = None) -> DataFrame:
    """All group metrics per scope.

    ``truth`` is any table with the scopes that have a truth: the others keep their row and their
    predicted units, and all their metrics are NULL. Without it every scope counts as known.

    Rates are 0 when their denominator is empty; quantity error and field
    accuracies are NULL when nothing was matched or the truth has no opinion.
    ``frames`` holds scope, pred_frames and true_frames.
    """
    total = lambda side: F.coalesce(F.sum(f"{side}_qty"), F.lit(0))
    fields = {n: _field(c) for n, c in (("glass", "glass"), ("ufactor", "u_bucket"), ("egress", "egress"))}
    sums = matches.groupBy(*scope).agg(
        _count("matched").alias("matched_groups"), _count("false_positive").alias("fp_groups"),
        _count("miss").alias("fn_groups"),
        total("pred").alias("pred_units_total"), total("true").alias("gt_units_total"),
        F.sum(F.when(F.col("status") == "matched", F.abs(F.col("pred_qty") - F.col("true_qty"))))
        .alias("_abs_qty"),
        *[c.alias(f"_{n}_{i}") for n, pair in fields.items() for i, c in enumerate(pair)])
    if frames is not None:
        sums = sums.join(frames, scope, "left")
    if truth is not None:
        known = truth.select(*scope).distinct().withColumn("_known", F.lit(True))
        sums = sums.join(known, scope, "left")
        compared = [c for c in sums.columns if c not in (*scope, "pred_units_total", "_known")]
        sums = sums.withColumns({c: F.when(F.col("_known"), F.col(c)) for c in compared})
    m, fp, fn = F.col("matched_groups"), F.col("fp_groups"), F.col("fn_groups")
    precision, recall = ratio(m, m + fp), ratio(m, m + fn)
    p, t = F.col("pred_units_total"), F.col("gt_units_total")
    frame_error = (F.when(F.col("true_frames") > 0, F.abs(F.col("pred_frames") - F.col("true_frames"))
                          / F.col("true_frames")) if frames is not None else F.lit(None).cast("double"))
    return sums.select(
        *scope, precision.alias("group_precision"), recall.alias("group_recall"),
        ratio(2 * precision * recall, precision + recall).alias("group_f1"),
        F.try_divide("_abs_qty", m).alias("qty_mae"), ratio(F.abs(p - t), t).alias("unit_count_error"),
        frame_error.alias("frame_count_error"),
        *[F.try_divide(F.col(f"_{n}_1"), F.col(f"_{n}_0")).alias(f"{n}_acc") for n in fields],
        ratio(fp, m + fp).alias("hallucination_rate"), ratio(fn, m + fn).alias("miss_rate"),
        "matched_groups", "fp_groups", "fn_groups", "pred_units_total", "gt_units_total")


def frame_totals(units: DataFrame, scope: list[str], name: str = "pred_frames") -> DataFrame:
    """Frames per scope: a unit counts once per panel, at least once."""
    return units.groupBy(*scope).agg(F.sum(
        F.col("qty").cast("bigint") * F.greatest(F.lit(1), F.size("panels"))).alias(name))


def gap_recall(predicted: DataFrame, true: DataFrame, scope: list[str], gap: str = "gap_id",
               scopes: DataFrame | None = None) -> DataFrame:
    """Share of true gap ids that were predicted; 1 for a scope without true gaps."""
    found = predicted.select(*scope, gap).distinct().withColumn("_found", F.lit(1.0))
    out = true.join(found, [*scope, gap], "left").groupBy(*scope).agg(
        F.avg(F.coalesce("_found", F.lit(0.0))).alias("gap_recall"))
    if scopes is None:
        return out
    return scopes.join(out, scope, "left").withColumn(
        "gap_recall", F.coalesce("gap_recall", F.lit(1.0)))


def flag_rates(flags: DataFrame, scope: list[str]) -> DataFrame:
    """Recall over injected rows (was each one flagged?) and precision over flagged rows.

    ``flags`` has booleans ``injected`` and ``flagged``. Rates of an empty set are 0.
    """
    both = F.count_if(F.col("injected") & F.col("flagged"))
    return flags.groupBy(*scope).agg(
        ratio(both, F.count_if("injected")).alias("error_recall"),
        ratio(both, F.count_if("flagged")).alias("error_precision"))


def score_flags(findings: DataFrame, injections: DataFrame, scope: list[str]) -> DataFrame:
    """Caught, missed and false flags per scope, with recall and precision.

    Expected and raised flags meet in one aggregation on (scope, unit, flag),
    which is a full outer join without the join. A scope without injections has
    recall 1.
    """
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    key = [*scope, "unit_id", "flag"]
    raised = findings.select(*key, one.alias("raised"), zero.alias("expected"))
    expected = injections.select(*scope, F.col("target_unit_id").alias("unit_id"),
                                 F.col("expected_flag").alias("flag"), zero.alias("raised"),
                                 one.alias("expected"))
    # the same flag raised twice on a unit counts once, two equal injections count twice
    pairs = raised.unionByName(expected).groupBy(*key).agg(
        F.max("raised").alias("raised"), F.sum("expected").alias("expected"))
    counts = pairs.groupBy(*scope).agg(
        F.sum(F.when(F.col("raised") > 0, F.col("expected")).otherwise(0)).alias("caught"),
        F.sum(F.when(F.col("raised") == 0, F.col("expected")).otherwise(0)).alias("missed"),
        F.count_if((F.col("raised") > 0) & (F.col("expected") == 0)).alias("false_flags"))
    return (counts
            .withColumn("recall", F.coalesce(F.try_divide("caught", F.col("caught") + F.col("missed")),
                                             F.lit(1.0)))
            .withColumn("precision", F.col("caught") / F.greatest(
                F.lit(1), F.col("caught") + F.col("false_flags"))))


def mean_flag_scores(scores: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Mean recall and precision over the variants."""
    return scores.groupBy(*(scope or [])).agg(
        F.avg("recall").alias("error_recall"), F.avg("precision").alias("error_precision"),
        F.count(F.lit(1)).alias("n_variants"))
