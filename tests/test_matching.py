"""Tolerance matching against brute force, and the shape of its plan."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from fenestra.operators.matching import (_assign, assign_nodes, candidate_edges, match_groups,
                                         match_units)
from fenestra.operators.spec_groups import group_units

PANEL = "role string, width_in double, height_in double, glass string, u_factor double, egress boolean"
UNIT = f"run string, kind string, panels array<struct<{PANEL}>>, qty int"


def window(w, h, qty=1, glass=None, u=None, egress=None, run="r"):
    return (run, "window", [("window", w, h, glass, u, egress)], qty)


def best_by_force(pred, true, tau):
    """(pairs, distance) of the best one-to-one matching of two short lists of (w, h)."""
    ok = {(i, j): abs(p[0] - t[0]) + abs(p[1] - t[1]) for i, p in enumerate(pred)
          for j, t in enumerate(true) if abs(p[0] - t[0]) + abs(p[1] - t[1]) <= tau}
    best = (0, 0.0)
    for n in range(1, min(len(pred), len(true)) + 1):
        costs = [sum(ok[a, b] for a, b in zip(c, d)) for c in itertools.combinations(range(len(pred)), n)
                 for d in itertools.permutations(range(len(true)), n)
                 if all((a, b) in ok for a, b in zip(c, d))]
        if costs:
            best = (n, min(costs))
    return best


def random_sizes(seed):
    rng = random.Random(seed)
    grid = [(30 + rng.randrange(5) * 0.5, 40 + rng.randrange(4) * 0.5) for _ in range(12)]
    sizes = sorted(set(grid))
    rng.shuffle(sizes)
    return sizes[:5], sorted({(w + rng.choice((0, .5, 1)), h + rng.choice((0, .5))) for w, h in sizes})[:5]


def totals(matches):
    row = matches.where("status = 'matched'").agg(
        F.count("*").alias("n"), F.coalesce(F.sum("distance"), F.lit(0.0)).alias("d")).first()
    return row.n, row.d


@pytest.mark.parametrize("max_local_edges", [4000, 0])
def test_best_assignment_equals_brute_force(spark, max_local_edges):
    """Both solvers: inside tasks, and by joins alone."""
    cases = {f"case{i}": random_sizes(i) for i in range(25 if max_local_edges else 3)}
    frame = lambda k: spark.createDataFrame(
        [window(w, h, run=run) for run, sides in cases.items() for w, h in sides[k]], UNIT)
    out = match_units(frame(0), frame(1), ["run"], max_local_edges=max_local_edges)
    got = {r.run: (r.n, r.d) for r in out.where("status = 'matched'").groupBy("run").agg(
        F.count("*").alias("n"), F.sum("distance").alias("d")).collect()}
    for run, (pred, true) in cases.items():
        assert got.get(run, (0, 0.0)) == best_by_force(pred, true, 1.0), run
    seen = out.groupBy("run").agg(F.count("pred_panels").alias("p"), F.count("true_panels").alias("t"))
    for r in seen.collect():
        assert (r.p, r.t) == tuple(len(side) for side in cases[r.run])


def test_both_solvers_agree_on_supplies(spark):
    """Several groups of one size, and chains where greedy would lose a pair."""
    rng = random.Random(5)
    rows = [("b", f"p{i}", f"t{j}", [i], [j], 1 + i % 3, 1 + j % 2, abs(i - j) % 3)
            for i in range(8) for j in range(max(0, i - 2), min(8, i + 2)) if rng.random() < .8]
    edges = spark.createDataFrame(rows, "block string, p string, t string, p_dims array<bigint>, "
                                  "t_dims array<bigint>, supply bigint, demand bigint, d bigint")
    total = lambda df: df.agg(F.sum("flow"), F.sum(F.col("flow") * F.col("d"))).first()
    assert tuple(total(assign_nodes(edges))) == tuple(total(assign_nodes(edges, max_local_edges=1)))


def test_a_tie_is_broken_alike_by_both_solvers(spark):
    pred = spark.createDataFrame([window(30.0, 40.0, 5), window(31.0, 40.0, 5)], UNIT)
    true = spark.createDataFrame([window(29.5, 40.0, 1), window(30.5, 40.0, 10), window(31.5, 40.0, 20)], UNIT)
    pairs = lambda limit: sorted((r.pred_panels[0][1], r.true_panels[0][1]) for r in match_units(
        pred, true, ["run"], max_local_edges=limit).where("status = 'matched'").collect())
    assert pairs(4000) == pairs(0)


def test_both_solvers_give_the_same_flows_in_tied_cases(spark):
    """300 blocks full of equal distances, supplies of one to three: the very same flow on every edge."""
    rng, rows = random.Random(11), []
    for b in range(300):
        n = rng.randrange(2, 6)
        supply, demand = [rng.randrange(1, 4) for _ in range(n)], [rng.randrange(1, 4) for _ in range(n)]
        rows += [(f"b{b}", f"{b}p{i}", f"{b}t{j}", [2 * i], [2 * j], supply[i], demand[j], rng.choice((1, 1, 2)))
                 for i in range(n) for j in range(n) if rng.random() < .7]
    edges = spark.createDataFrame(rows, "block string, p string, t string, p_dims array<bigint>, "
                                  "t_dims array<bigint>, supply bigint, demand bigint, d bigint")
    flows = lambda **k: sorted(tuple(r) for r in assign_nodes(edges, **k).where("flow > 0").collect())
    assert flows() == flows(max_local_edges=0)


def test_without_tolerance_one_join_gives_the_same(spark):
    rng = random.Random(3)
    side = lambda: spark.createDataFrame([window(30.0 + rng.randrange(4) / 4, 40.0, rng.randrange(1, 4), rng.choice(("a", "b")), run=f"r{k % 5}")
                                          for k in range(80)], UNIT)
    pred, true = side(), side()
    got = match_units(pred, true, ["run"], tau_in=0.0)
    same = match_units(pred, true, ["run"], tau_in=1e-9)
    assert got.columns == same.columns and sorted(map(str, got.collect())) == sorted(map(str, same.collect()))


def test_greedy_would_lose_a_pair():
    edges = [("p1", "t1", 0), ("p1", "t2", 2), ("p2", "t1", 2)]
    flow = _assign(edges, {"p1": 1, "p2": 1}, {"t1": 1, "t2": 1})
    assert flow == {("p1", "t2"): 1, ("p2", "t1"): 1}


def test_exact_within_and_outside_tolerance(spark):
    truth = spark.createDataFrame([window(72.5, 88.5, 63, "mixed", .24, True)], UNIT)
    at = lambda h, glass="mixed": match_units(
        spark.createDataFrame([window(72.5, h, 63, glass, .24, True)], UNIT), truth, ["run"]).collect()
    assert [(m.status, m.distance) for m in at(88.5)] == [("matched", 0.0)]
    assert [(m.status, m.distance) for m in at(88.0)] == [("matched", 0.5)]
    assert sorted(m.status for m in at(95.0)) == ["false_positive", "miss"]
    assert [m.status for m in at(88.5, "annealed")] == ["matched"]  # glass does not block a match


def test_mirror_fold_and_roles(spark):
    a, b = ("window", 36.1875, 96.0, None, .23, None), ("door", 36.1875, 96.0, None, .23, True)
    pred = spark.createDataFrame([("r", "composite", [a, b], 2), ("r", "composite", [b, a], 3)], UNIT)
    true = spark.createDataFrame([("r", "composite", [a, b], 5)], UNIT)
    assert [(m.pred_qty, m.true_qty) for m in match_units(pred, true, ["run"]).collect()] == [(5, 5)]
    other = spark.createDataFrame([("r", "composite", [a, a], 5)], UNIT)
    assert sorted(m.status for m in match_units(pred, other, ["run"]).collect()) == ["false_positive", "miss"]


def test_tolerance_grows_with_panels_and_uses_all_sizes(spark):
    panel = lambda w, h: ("window", w, h, None, None, None)
    three = lambda *ws: ("r", "composite", [panel(w, 80.0) for w in ws], 1)
    true = spark.createDataFrame([three(20.0, 40.0, 60.0)], UNIT)
    near = spark.createDataFrame([three(21.0, 41.0, 61.0)], UNIT)
    far = spark.createDataFrame([three(21.0, 42.0, 60.5)], UNIT)
    assert [m.distance for m in match_units(near, true, ["run"]).collect()] == [3.0]
    assert len(match_units(far, true, ["run"]).collect()) == 2


def test_units_without_panels_match_each_other(spark):
    one = spark.createDataFrame([("r", "window", [], 2)], UNIT)
    assert [(m.status, m.pred_qty) for m in match_units(one, one, ["run"]).collect()] == [("matched", 2)]


def test_groups_of_equal_size_pair_up_one_to_one(spark):
    rows = lambda glasses: [window(30.0, 40.0, 1, g) for g in glasses]
    pred = spark.createDataFrame(rows(["annealed", "mixed", "tempered"]), UNIT)
    true = spark.createDataFrame(rows(["mixed", "tempered"]), UNIT)
    out = match_units(pred, true, ["run"])
    assert totals(out) == (2, 0.0)
    assert out.where("status = 'false_positive'").count() == 1
    assert match_units(pred, true, ["run"], mode="dims").count() == 1


def test_edges_come_from_an_equi_join(spark, tmp_path):
    spark.createDataFrame([window(30.0 + i, 40.0, run=f"r{i % 3}") for i in range(9)], UNIT) \
        .write.parquet(str(tmp_path / "u"))
    groups = group_units(spark.read.parquet(str(tmp_path / "u")), ["run"])
    plan = candidate_edges(groups, groups, ["run"])._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_a_large_component_is_solved_alike(spark):
    """Thousands of edges in one component: the auction, in one square and in several, against the solver inside a task."""
    from fenestra.operators import matching
    from fenestra.plans.queries import _lattice_units

    rows = spark.range(1_800)
    side = lambda r: _lattice_units(rows.where(F.col("id") % 3 == r), "id")
    pred, true = (group_units(side(r), ["project"]) for r in (0, 1))
    edges = candidate_edges(pred, true, ["project"])
    assert edges.count() > matching.MAX_LOCAL_EDGES
    flows = lambda **k: sorted(tuple(r) for r in assign_nodes(edges, **k).where("flow > 0").collect())
    local = flows(max_local_edges=10 ** 9)
    assert len(local) > 400 and flows() == local


def test_squares_smaller_than_the_component(spark):
    rng = random.Random(21)
    rows = [("b", f"p{i}", f"t{j}", [4 * i], [4 * j], rng.randrange(1, 3), rng.randrange(1, 3), abs(i - j) % 3)
            for i in range(0, 60) for j in range(i, min(60, i + 2)) if rng.random() < .9]
    supply = {r[1]: r[5] for r in rows}
    demand = {r[2]: r[6] for r in rows}
    edges = spark.createDataFrame([(*r[:5], supply[r[1]], demand[r[2]], r[7]) for r in rows], "block string, p string, t string, "
                                  "p_dims array<bigint>, t_dims array<bigint>, supply bigint, demand bigint, d bigint")
    flows = lambda **k: sorted(tuple(r) for r in assign_nodes(edges, tau_in=4.0, **k).where("flow > 0").collect())
    assert flows(max_local_edges=0, max_square_offers=120) == flows()
