"""Rule checks, injected defects and their scores."""

from pyspark.sql import functions as F

from fenestra.operators import injection, metrics, rules

PANEL = ("role string, width_in double, height_in double, glass string, u_factor double, egress boolean, "
         "clear_opening_sqft double")
UNIT = f"unit_id string, kind string, panels array<struct<{PANEL}>>, qty int"


def clean(spark):
    w = lambda width, glass="mixed": [("window", width, 88.5, glass, .24, True, None)]
    part = lambda role: (role, 36.0, 96.0, None, None, None, None)
    rows = [("W1", "window", w(72.5), 63), ("W2", "window", w(48.1875), 85), ("W3", "window", w(42.0), 10),
            ("W4", "window", w(72.5, "annealed"), 4), ("W5", "window", w(32.1875), 6), ("W6", "window", w(68.5, "tempered"), 1),
            ("W7", "window", w(124.5, "tempered"), 1), ("U1", "composite", [part("window"), part("door")], 42),
            ("U2", "composite", [part("window"), part("window"), part("door")], 5), ("D1", "door", [part("door")], 1)]
    return spark.createDataFrame(rows, UNIT).withColumn("project", F.lit("p"))


def check(units, reference, scope):
    counts, sizes = injection.baseline_of(reference, ["unit_id"])
    return rules.check_units(units, ["unit_id"], counts, sizes)


def test_clean_truth_raises_nothing(spark):
    truth = clean(spark)
    assert rules.findings(check(truth, truth, []), ["project"]).count() == 0


def test_every_injected_defect_is_found(spark):
    truth = clean(spark)
    variants = injection.inject(truth)
    assert variants.count() == 10 * truth.count()
    scope = ["project", "variant_id"]
    marks = rules.missing_marks(injection.plan_marks(variants, ["project"]), variants.select(*scope, "unit_id"), scope)
    found = rules.findings(check(variants, truth, scope), scope, marks)
    expected = injection.injections(variants, ["project"])
    scores = metrics.score_flags(found, expected, scope)
    assert sorted((r.variant_id, r.caught, r.missed, r.recall) for r in scores.collect()) == sorted(
        (d.variant_id, 1, 0, 1.0) for d in injection.DEFECTS)
    assert metrics.mean_flag_scores(scores).first().error_recall == 1.0
    # a silent checker and one false alarm
    silent = metrics.score_flags(found.limit(0), expected, scope)
    assert {(r.recall, r.precision) for r in silent.collect()} == {(0.0, 0.0)}
    noisy = found.unionByName(found.limit(1).withColumn("flag", F.lit("made_up")))
    assert metrics.score_flags(noisy, expected, scope).agg(F.sum("false_flags")).first()[0] == \
        scores.agg(F.sum("false_flags")).first()[0] + 1


def test_edge_cases_of_single_rules(spark):
    flags = lambda panels, kind="window", **attrs: sorted(rules.check_units(
        spark.createDataFrame([("u", kind, panels, 2)], UNIT).withColumns({k: F.lit(v) for k, v in attrs.items()}))
        .first().check_flags)
    p = lambda glass=None, u=None, egress=None, clear=None: ("window", 30.0, 40.0, glass, u, egress, clear)
    assert flags([p(clear=5.0)]) == []                                  # no egress, no bedroom
    assert flags([p(clear=5.0)], room_label="BedRoom") == [rules.EGRESS_UNDERSIZE]
    assert flags([p(clear=5.7, egress=True)]) == []
    assert flags([p("annealed")], sill_height_in=18.0) == []
    assert flags([p("annealed")], tempered_zone=True) == []             # only unknown glass is flagged
    assert flags([p()], tempered_zone=True) == [rules.ZONE_WITHOUT_GLASS]
    assert flags([p("annealed")], tempered_required=True) == [rules.TEMPERED_CONFLICT]
    assert flags([p(u=0.27)]) == [] and flags([p(u=0.28)]) == [rules.UFACTOR_BREACH]
    assert flags([p()], facade_count=3) == [] and flags([p()], facade_count=4) == [rules.FACADE_MISMATCH]
    assert flags([p()], "composite") == [rules.PANEL_COUNT] and flags([], "composite") == [rules.PANEL_COUNT]
    assert flags([p("annealed"), p("annealed")], adjacent_door=True) == [rules.NEAR_DOOR_ANNEALED]


def test_rules_share_one_scan(spark):
    plan = rules.check_units(clean(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("Scan") == 1


def test_flag_rates(spark):
    rows = [(True, True), (True, True), (True, False), (False, True)]
    df = spark.createDataFrame(rows, "injected boolean, flagged boolean").withColumn("k", F.lit(1))
    r = metrics.flag_rates(df, ["k"]).first()
    assert (round(r.error_recall, 3), round(r.error_precision, 3)) == (.667, .667)
    empty = metrics.flag_rates(df.where("not injected and not flagged"), []).first()
    assert (empty.error_recall, empty.error_precision) == (0.0, 0.0)
