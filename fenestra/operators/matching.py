"""Tolerance matching of predicted to true spec groups, one to one.

Same kind and same panel roles; the summed size difference may be at most
``tau`` inches per panel; the result has as many pairs as possible and, among
those, the least total difference. Where several assignments are equally good, a
number made from each pair of sizes decides (the least sum of them), so there is one
best assignment, and the result is the same whichever way it is found.

How it is laid out for Spark:

* Groups with equal sizes are interchangeable, so they become one *node* with a
  supply (predicted side) or a demand (true side). Quantities were summed before.
* Candidate edges come from an equi-join on grid cells of the sizes, never from all
  pairs of a block.
* An edge whose two nodes have no other edge is settled at once.
* The rest falls into components separated by gaps in the occupied cells. Small
  ones are solved inside tasks, each task streaming over many components. Large
  ones are solved by an auction in rounds over squares of sizes
  (``_solve_distributed``), so no component has to fit into one task. The limit
  between the two picks the way, not the result.
* Without a tolerance, sizes match only themselves: one full outer join does it.
* Where a count shows scopes to be so small that a task may solve each of them, the units of
  both sides are shuffled once, by scope, and grouped and matched there (``_match_small``); the
  rest takes the way above. The result is the same.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import sys
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from fenestra.operators.spec_groups import DEFAULT_BUCKET, group_units, with_key
from fenestra.session import stage

# the in-task functions travel with the plan; executors need no installed copy
cloudpickle.register_pickle_by_value(sys.modules[__name__])

DEFAULT_TAU_IN = 1.0
#: Edges of a component that one task may solve.
MAX_LOCAL_EDGES = 4_000
#: An edge costs its distance times two to this power, plus a tie-breaking number of 48 bits.
TIE_SHIFT, TIE_BITS = 72, 48
#: The auction's bid step is divided by this from phase to phase; offers in a square that one task may hold.
STEP, MAX_SQUARE_OFFERS = 16, 40_000

_EDGE = ["block", "p", "t", "d"]
_FLOW = "comp string, p string, t string, flow bigint"


def _block(scope: list[str]) -> Column:
    """Groups can only match within a block: same scope, kind and panel roles."""
    roles = F.concat_ws("+", F.transform(F.col("key_panels"),
                                         lambda p: F.coalesce(p["role"], F.lit("None"))))
    return F.struct(*[F.col(c) for c in scope], F.col("kind"), roles.alias("roles"))


def _block_text(block: Column) -> Column:
    # microseconds kept: the text of a block must be as distinct as the block
    return F.to_json(F.struct(block.alias("block")), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"})


def _named(groups: DataFrame, scope: list[str], bucket: float) -> DataFrame:
    """Groups with their block, size vector and node name."""
    steps = lambda v: F.rint(v / F.lit(bucket)).cast("bigint")
    dims = F.flatten(F.transform(F.col("key_panels"), lambda p: F.array(steps(p["w"]), steps(p["h"]))))
    return groups.withColumn("block", _block(scope)).withColumn("dims", dims).withColumn(
        "node", F.concat_ws(",", F.col("dims").cast("array<string>")))


def _variants(groups: DataFrame, scope: list[str], bucket: float) -> DataFrame:
    """Groups with their block, size vector, node name and rank among equal sizes."""
    named = _named(groups, scope, bucket)
    same = Window.partitionBy("block", "node").orderBy("key_panels")
    return named.withColumn("rank", F.row_number().over(same))


def _nodes(variants: DataFrame) -> DataFrame:
    return variants.groupBy("block", "node", "dims").agg(F.count(F.lit(1)).alias("units"))


def _at(dims: Column, i: int) -> Column:
    return F.coalesce(F.get(dims, F.lit(i)), F.lit(0))


def _edges(pred: DataFrame, true: DataFrame, tau_in: float, bucket: float) -> DataFrame:
    """Node pairs within tolerance, found through shared grid cells.

    The grid is laid over the sums of the widths and of the heights, which cannot
    differ by more than the tolerance, and for several panels over the width of
    the last one. A cell is four tolerances wide; the true side is entered in the
    one or two cells per axis that it can reach.
    """
    panels = lambda dims: (F.size(dims) / 2).cast("int")
    limit = lambda dims: F.floor(panels(dims) * F.lit(tau_in / bucket)).cast("bigint")
    total = lambda dims, odd: F.aggregate(F.filter(dims, lambda v, i: i % 2 == odd), F.lit(0).cast("bigint"),
                                          lambda acc, v: acc + v)
    last = lambda dims: F.when(panels(dims) > 1, F.get(dims, F.size(dims) - 2)).otherwise(F.lit(0))
    axes = lambda dims: [total(dims, 0), total(dims, 1), last(dims)]
    cell = lambda v, reach: F.floor(v / F.greatest(4 * reach, F.lit(1))).cast("bigint")

    left = pred.select("block", F.col("node").alias("p"), F.col("dims").alias("p_dims"),
                       F.col("units").alias("supply"),
                       *[cell(v, limit(F.col("dims"))).alias(f"c{i}") for i, v in enumerate(axes(F.col("dims")))])
    right = true.select("block", F.col("node").alias("t"), F.col("dims").alias("t_dims"),
                        F.col("units").alias("demand"), limit(F.col("dims")).alias("_reach"),
                        *[v.alias(f"c{i}") for i, v in enumerate(axes(F.col("dims")))])
    for i in range(3):
        v, reach = F.col(f"c{i}"), F.col("_reach")
        right = right.withColumn(f"c{i}", F.explode(F.sequence(cell(v - reach, reach), cell(v + reach, reach))))
    distance = F.aggregate(F.zip_with("p_dims", "t_dims", lambda a, b: F.abs(a - b)),
                           F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    joined = left.join(right.drop("_reach"), ["block", "c0", "c1", "c2"])
    return joined.withColumn("d", distance).where(F.col("d") <= limit(F.col("p_dims"))).select(
        "block", "p", "t", "p_dims", "t_dims", "supply", "demand", "d")


def _degrees(edges: DataFrame) -> DataFrame:
    for side in ("p", "t"):
        edges = edges.withColumn(f"{side}_deg", F.count(F.lit(1)).over(Window.partitionBy("block", side)))
    return edges


def tie_number() -> Column:
    """48 bits from the two sizes of an edge; sums of them are as good as never equal."""
    pair = F.concat_ws("|", "p", "t")
    return F.conv(F.substring(F.md5(pair), 1, 12), 16, 10).cast("bigint")


def _islands(edges: DataFrame, tau_in: float, bucket: float) -> DataFrame:
    """Add ``comp``: edges in different islands share no node.

    The occupied cells of a size, in order, break where a cell is skipped; first
    by the first width, then by the first height inside each width island. Only
    distinct cells are ordered, so a crowded block costs no more than its range.
    """
    edges = edges.withColumn("comp", _block_text(F.col("block")))
    for i in (0, 1):
        size = lambda dims: F.greatest(F.floor(F.size(dims) / 2 * F.lit(tau_in / bucket)), F.lit(1))
        cell = lambda dims: F.floor(_at(dims, i) / size(dims)).cast("bigint")
        edges = edges.withColumn("_cell", cell(F.col("p_dims")))
        both = edges.select("comp", "_cell").unionByName(
            edges.select("comp", cell(F.col("t_dims")).alias("_cell"))).distinct()
        order = Window.partitionBy("comp").orderBy("_cell")
        gap = F.col("_cell") - F.lag("_cell").over(order) > 1
        islands = both.withColumn("_gap", F.coalesce(gap, F.lit(False)).cast("int")).withColumn(
            "_island", F.sum("_gap").over(order)).drop("_gap")
        edges = edges.join(islands, ["comp", "_cell"]).withColumn(
            "comp", F.concat_ws("/", "comp", F.col("_island").cast("string"))).drop("_cell", "_island")
    return edges


def _assign(edges: list[tuple], supply: dict, demand: dict) -> dict:
    """Successive cheapest augmenting paths on one small component -> {(p, t): flow}."""
    cost = {(p, t): d for p, t, d in edges}
    out: dict = {}
    for p, t, _ in edges:
        out.setdefault(p, []).append(t)
    inflow: dict = {t: {} for _, t, _ in edges}
    while True:
        # residual distances from every node with supply left
        dist = {p: 0 for p in out if supply[p] > 0}
        parent: dict = {}
        reach: dict = {}
        frontier = sorted(dist)
        while frontier:
            changed = set()
            for p in frontier:
                for t in out[p]:
                    if t not in reach or dist[p] + cost[p, t] < reach[t][0]:
                        reach[t] = (dist[p] + cost[p, t], p)
                        changed.add(t)
            improved = set()
            for t in sorted(changed):
                for p in inflow[t]:
                    back = reach[t][0] - cost[p, t]
                    if p not in dist or back < dist[p]:
                        dist[p], parent[p] = back, t
                        improved.add(p)
            frontier = sorted(improved)
        ends = [(c, t) for t, (c, _) in reach.items() if demand[t] > 0]
        if not ends:
            return {(p, t): x for t, flows in inflow.items() for p, x in flows.items()}
        last = min(ends)[1]
        path, t, amount = [], last, demand[last]
        while True:
            p = reach[t][1]
            path.append((p, t, 1))
            if p not in parent:
                break
            t = parent[p]
            path.append((p, t, -1))
            amount = min(amount, inflow[t][p])
        amount = min(amount, supply[p])
        supply[p] -= amount
        demand[last] -= amount
        for p, t, sign in path:
            flow = inflow[t].pop(p, 0) + sign * amount
            if flow:
                inflow[t][p] = flow


def _solve_streaming(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows arrive sorted by component; one component is held at a time."""
    pending: list[tuple] = []

    def solve() -> list[tuple]:
        supply = {p: s for _, p, _, _, _, s, _ in pending}
        demand = {t: d for _, _, t, _, _, _, d in pending}
        flow = _assign([(p, t, (d << TIE_SHIFT) + tie) for _, p, t, d, tie, _, _ in pending], supply, demand)
        return [(pending[0][0], p, t, x) for (p, t), x in sorted(flow.items())]

    frame = lambda rows: pd.DataFrame(rows, columns=["comp", "p", "t", "flow"])
    for batch in batches:
        done: list[tuple] = []
        for row in batch.itertuples(index=False, name=None):
            if pending and row[0] != pending[0][0]:
                done.extend(solve())
                pending = []
            pending.append(row)
        yield frame(done)
    if pending:
        yield frame(solve())


def _solve_local(edges: DataFrame) -> DataFrame:
    rows = edges.select("comp", "p", "t", "d", "tie", "supply", "demand").repartition("comp")
    flows = rows.sortWithinPartitions("comp", "p", "t").mapInPandas(_solve_streaming, _FLOW)
    return edges.select("comp", *_EDGE).join(flows, ["comp", "p", "t"]).select(*_EDGE, "flow")


def _mirrored(edges: DataFrame) -> DataFrame:
    """comp, name, copies, cells, edges(o, d, tie, cells): who bids for what.

    Every node bids on its own side and is bid for on a mirrored one, where each node may also stay with itself (``d`` is NULL). So
    everybody gets something, a pair on one side is a pair on the other, and as few nodes as possible stay with themselves.
    """
    offer = lambda o, cells: F.struct(o.alias("o"), F.col("d").alias("d"), F.col("tie").alias("tie"), F.col(cells).alias("cells"))
    sides = []
    for own, other, copies in (("p", "t", "supply"), ("t", "p", "demand")):
        o = F.concat(F.lit(f"{other}:"), F.col(other))
        sides.append(edges.groupBy("comp", F.concat(F.lit(f"{own}:"), F.col(own)).alias("name")).agg(
            F.any_value(copies).cast("bigint").alias("copies"), F.any_value(f"{own}_cells").alias("cells"),
            F.collect_list(offer(o, f"{other}_cells")).alias("edges")))  # the nodes within the tolerance of one
    both = sides[0].unionByName(sides[1])
    alone = F.struct(F.col("name").alias("o"), F.lit(None).cast("bigint").alias("d"), F.lit(0).cast("bigint").alias("tie"), F.col("cells").alias("cells"))
    return both.withColumn("edges", F.array_append("edges", alone))


def _square(cells: Column, width: int, shift: int) -> Column:
    """Name of the square of cells, ``width`` per axis, that a node lies in; an odd ``shift`` moves the grid at random."""
    moved = lambda c, i: c + F.pmod(F.xxhash64(F.lit(shift), i), F.lit(width)) if shift % 2 else c
    return F.concat_ws(",", F.transform(cells, lambda c, i: F.floor(moved(c, i) / width).cast("string")))


def _auction(persons: list[tuple], objects: list[tuple], eps: int, cost) -> list[tuple]:
    """Bids inside one square until each of its persons has something; (object, slot, price, owner) of all objects.

    ``persons``: (name, copies, offers); an object has the price of its cheapest slot.
    """
    slots: dict[str, list] = {}
    owners = set()
    for o, slot, price, owner in objects:
        slots.setdefault(o, []).append((price, slot, owner))
        owners.add(owner)
    for heap in slots.values():
        heapq.heapify(heap)
    offers = {name: [(o, cost(d, tie)) for o, d, tie in own] for name, _, own in persons}
    waiting = [f"{name}#{k}" for name, copies, _ in persons for k in range(copies) if f"{name}#{k}" not in owners]
    while waiting:
        person = waiting.pop()
        best = second = None
        for o, c in offers[person[:person.rindex("#")]]:
            heap = slots[o]
            value = -c - heap[0][0]
            if best is None or value > best:
                best, second, chosen = value, best, o
            elif second is None or value > second:
                second = value
            if len(heap) > 1:  # the next slot of the same object
                value = -c - min(heap[1:3])[0]
                if second is None or value > second:
                    second = value
        price, slot, owner = slots[chosen][0]
        heapq.heapreplace(slots[chosen], (price + best - second + eps, slot, person))
        if owner is not None and owner[:owner.rindex("#")] in offers:
            waiting.append(owner)
    return [(o, slot, price, owner) for o, heap in slots.items() for price, slot, owner in heap]


_STATE = "comp string, name string, slot bigint, cells array<bigint>, price string, owner string"


def _auction_round(bidders: DataFrame, state: DataFrame, eps: int, width: int, shift: int, scale: int, bits: int, alone: int) -> DataFrame:
    """One round: every square of the grid holds its auction; who has an offer in another square waits for a grid that has moved."""
    square = lambda cells: _square(cells, width, shift)
    inside = bidders.withColumn("square", square(F.col("cells"))).where(
        F.forall("edges", lambda e: square(e["cells"]) == F.col("square")))
    rows = inside.select("comp", "square", F.lit(0).alias("kind"), "name", F.col("copies").alias("slot"), "cells",
                         F.lit(None).cast("string").alias("price"), F.lit(None).cast("string").alias("owner"),
                         F.transform("edges", lambda e: F.struct(e["o"].alias("o"), e["d"].alias("d"), e["tie"].alias("tie"))).alias("edges"))
    held = state.withColumn("square", square(F.col("cells"))).withColumn("kind", F.lit(1))
    dealt = rows.unionByName(held, allowMissingColumns=True).repartition("comp", "square").sortWithinPartitions("comp", "square", "kind", "name", "slot")
    cost = lambda d, tie: scale * (alone if d is None else (d << bits) + tie)

    def solve(group: list[tuple]) -> list[tuple]:
        comp = group[0][0]
        persons = [(r[3], r[4], [(e["o"], e["d"], e["tie"]) for e in r[8]]) for r in group if r[2] == 0]
        cells = {r[3]: r[5] for r in group if r[2] == 1}
        found = _auction(persons, [(r[3], r[4], int(r[6]), r[7]) for r in group if r[2] == 1], eps, cost)
        return [(comp, o, slot, cells[o], str(price), owner) for o, slot, price, owner in found]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("comp", pa.string()), ("name", pa.string()), ("slot", pa.int64()), ("cells", pa.list_(pa.int64())),
                            ("price", pa.string()), ("owner", pa.string())])
        frame = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * 6, schema)], schema=schema)
        group: list[tuple] = []
        for batch in batches:
            done: list[tuple] = []
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if group and row[:2] != group[0][:2]:
                    done += solve(group)
                    group = []
                group.append(row)
            yield frame(done)
        if group:
            yield frame(solve(group))

    return dealt.select("comp", "square", "kind", "name", "slot", "cells", "price", "owner", "edges").mapInArrow(task, _STATE)


def _from_corner(bidders: DataFrame) -> DataFrame:
    """Cells counted from the least ones of the component, so a component as large as a square lies in one."""
    corner = bidders.select("comp", F.posexplode("cells").alias("i", "c")).groupBy("comp", "i").agg(F.min("c").alias("c"))
    corner = corner.groupBy("comp").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "c"))), lambda x: x["c"]).alias("corner"))
    moved = lambda cells: F.zip_with(cells, F.col("corner"), lambda c, least: c - least)
    return bidders.join(corner, "comp").select(
        "comp", "name", "copies", moved(F.col("cells")).alias("cells"), F.transform("edges", lambda e: F.struct(
            e["o"].alias("o"), e["d"].alias("d"), e["tie"].alias("tie"), moved(e["cells"]).alias("cells"))).alias("edges"))


def _width(bidders: DataFrame, most: int) -> int:
    """Cells per side of the squares: the largest for which no square has more than ``most`` offers, four at least."""
    width = 4
    while width < 1 << 16:
        wider = width * 2
        fullest = bidders.groupBy("comp", _square(F.col("cells"), wider, 0)).agg(F.sum(F.size("edges")).alias("n")).agg(F.max("n")).first()[0]
        if fullest > most:
            break
        width = wider
    return width


def _solve_distributed(edges: DataFrame, tau_in: float, bucket: float, most: int = MAX_SQUARE_OFFERS) -> DataFrame:
    """Exact assignment of components of any size: an auction with falling bid steps, in squares of a grid.

    Nodes bid for the best offer, by as much as it is better than the second best, plus a step; who is outbid bids again. All
    costs are multiples of more than the number of bids that can be open, so with a last step of 1 the result is the best
    assignment. The step starts at a share of the largest cost and is divided by ``STEP`` per phase; prices
    stay. In a round, a task holds the auction of a square of sizes; in every second round the grid moves. So the number of phases
    grows with the logarithm of the cost range, and tasks do not grow with the component. A component as large as a square takes one
    round per phase, a larger one as many as prices need to settle across borders.
    """
    limit = lambda dims: F.greatest(F.floor(F.size(dims) / 2 * F.lit(tau_in / bucket)), F.lit(1))
    cells = lambda dims: F.transform(dims, lambda v: F.floor(v / limit(dims)).cast("bigint"))
    placed = edges.withColumn("p_cells", cells(F.col("p_dims"))).withColumn("t_cells", cells(F.col("t_dims")))
    bidders = stage(_from_corner(_mirrored(placed)), "bidders")
    slots = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1))
    state = bidders.select("comp", "name", slots.alias("slot"), "cells", F.lit("0").alias("price"), F.lit(None).cast("string").alias("owner"))
    size = bidders.groupBy("comp").agg(F.sum("copies").alias("n")).agg(F.max("n").alias("n")).first()["n"]
    top = edges.agg(F.max("d")).first()[0]
    bits = TIE_BITS + 1 + int(size).bit_length()
    alone = (top + 1 << bits) * (size + 1)
    scale, width = size + 1, _width(bidders, most)
    eps, turn = scale * alone // STEP + 1, 0
    while True:
        state = state.withColumn("owner", F.lit(None).cast("string"))
        while True:
            state = stage(_auction_round(bidders, state, eps, width, turn, scale, bits, alone), "auction")
            turn += 1
            if state.where("owner is null").isEmpty():
                break
        if eps == 1:
            break
        eps = max(1, eps // STEP)
    pair = state.where("name like 't:%' and owner like 'p:%'").select(
        "comp", F.expr("substr(owner, 3, length(owner) - 2 - locate('#', reverse(owner)))").alias("p"), F.expr("substr(name, 3)").alias("t"))
    flows = pair.groupBy("comp", "p", "t").agg(F.count(F.lit(1)).alias("flow"))
    return edges.select("comp", *_EDGE).join(flows, ["comp", "p", "t"]).select(*_EDGE, "flow")


def assign_nodes(edges: DataFrame, tau_in: float = DEFAULT_TAU_IN, bucket: float = DEFAULT_BUCKET,
                 max_local_edges: int = MAX_LOCAL_EDGES, max_square_offers: int = MAX_SQUARE_OFFERS) -> DataFrame:
    """Optimal flow on node edges: block, p, t, d (in buckets), flow."""
    edges = stage(_degrees(edges), "edges")
    alone = (F.col("p_deg") == 1) & (F.col("t_deg") == 1)
    settled = edges.where(alone).select(
        *_EDGE, F.least("supply", "demand").cast("bigint").alias("flow"))
    rest = stage(_islands(edges.where(~alone).withColumn("tie", tie_number()), tau_in, bucket), "components")
    sizes = rest.groupBy("comp").agg(F.count(F.lit(1)).alias("n_edges"))
    if sizes.where(F.col("n_edges") > max_local_edges).isEmpty():
        return settled.unionByName(_solve_local(rest))
    rest = stage(rest.join(sizes, "comp"), "components")
    small = rest.where(F.col("n_edges") <= max_local_edges)
    large = rest.where(F.col("n_edges") > max_local_edges).drop("n_edges")
    return settled.unionByName(_solve_local(small)).unionByName(_solve_distributed(large, tau_in, bucket, max_square_offers))


def candidate_edges(pred_groups: DataFrame, true_groups: DataFrame, scope: list[str],
                    tau_in: float = DEFAULT_TAU_IN, bucket: float = DEFAULT_BUCKET) -> DataFrame:
    """Size pairs within tolerance, before the assignment."""
    return _edges(_nodes(_variants(pred_groups, scope, bucket)),
                  _nodes(_variants(true_groups, scope, bucket)), tau_in, bucket)


def match_groups(pred_groups: DataFrame, true_groups: DataFrame, scope: list[str],
                 tau_in: float = DEFAULT_TAU_IN, bucket: float = DEFAULT_BUCKET,
                 max_local_edges: int = MAX_LOCAL_EDGES) -> DataFrame:
    """Matched pairs, false positives and misses of two grouped tables.

    Within equal sizes, pairs follow the order of the full key, so the result
    does not depend on the order of the input.
    """
    side = lambda v, prefix, node: v.select(
        "block", F.col("node").alias(node), F.col("rank").cast("bigint").alias(f"{node}_rank"),
        *[F.col(c).alias(f"{prefix}_{c}") for c in [*scope, "kind"]],
        F.col("key_panels").alias(f"{prefix}_panels"), F.col("qty").alias(f"{prefix}_qty"))
    if tau_in == 0:
        left = side(_variants(pred_groups, scope, bucket), "pred", "p").select(
            "*", F.col("p").alias("t"), F.col("p_rank").alias("t_rank"), F.lit(0).cast("bigint").alias("d"))
        both = left.join(side(_variants(true_groups, scope, bucket), "true", "t"), ["block", "t", "t_rank"], "full_outer")
        return _matched(both, scope, bucket)
    # both sides are read twice below: once for the nodes, once for the result
    pred = stage(_variants(pred_groups, scope, bucket), "predicted")
    true = stage(_variants(true_groups, scope, bucket), "true")
    flows = assign_nodes(_edges(_nodes(pred), _nodes(true), tau_in, bucket), tau_in, bucket,
                         max_local_edges)
    before = lambda a, b: F.coalesce(F.sum("flow").over(
        Window.partitionBy("block", a).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # unit k of a flow is the next unused rank on both sides
    pairs = flows.withColumn("p0", before("p", "t")).withColumn("t0", before("t", "p")).withColumn(
        "k", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("flow")))).select(
        "block", "p", "t", "d", (F.col("p0") + F.col("k")).alias("p_rank"),
        (F.col("t0") + F.col("k")).alias("t_rank"))
    left = side(pred, "pred", "p").join(pairs, ["block", "p", "p_rank"], "left")
    return _matched(left.join(side(true, "true", "t"), ["block", "t", "t_rank"], "full_outer"), scope, bucket)


def _matched(both: DataFrame, scope: list[str], bucket: float) -> DataFrame:
    """The result columns of the two joined sides."""
    either = lambda c: F.coalesce(F.col(f"pred_{c}"), F.col(f"true_{c}")).alias(c)
    matched = F.col("pred_qty").isNotNull() & F.col("true_qty").isNotNull()
    return both.select(
        *[either(c) for c in [*scope, "kind"]], "pred_panels", "true_panels",
        F.coalesce("pred_qty", F.lit(0)).alias("pred_qty"),
        F.coalesce("true_qty", F.lit(0)).alias("true_qty"),
        F.when(matched, F.col("d") * F.lit(bucket)).alias("distance"),
        F.when(matched, "matched").when(F.col("pred_qty").isNotNull(), "false_positive")
        .otherwise("miss").alias("status"))


def _tie(p: str, t: str) -> int:
    """``tie_number`` of one edge."""
    return int(hashlib.md5(f"{p}|{t}".encode()).hexdigest()[:12], 16)


def _block_pairs(pred: list[tuple], true: list[tuple], per_panel: float) -> Iterator[tuple]:
    """(row, row, distance) of one block.

    ``pred`` and ``true``: (row, node, known) ordered by node and rank; sizes that are not ``known`` have no edges, but a rank.
    """
    sides: tuple[dict, dict] = ({}, {})
    copies: tuple[dict, dict] = ({}, {})
    for side, units, rows in zip(sides, copies, (pred, true)):
        for row, node, known in rows:
            side.setdefault(node, []).append(row)
            if known:
                units[node] = units.get(node, 0) + 1
    sizes = [{node: [int(v) for v in node.split(",")] if node else [] for node in units} for units in copies]
    edges, degree = [], {}
    for p, a in sizes[0].items():
        limit = math.floor(len(a) // 2 * per_panel)
        for t, b in sizes[1].items():
            if len(a) == len(b):
                d = sum(abs(x - y) for x, y in zip(a, b))
                if d <= limit:
                    edges.append((p, t, d))
                    degree[0, p] = degree.get((0, p), 0) + 1
                    degree[1, t] = degree.get((1, t), 0) + 1
    alone = lambda e: degree[0, e[0]] == 1 and degree[1, e[1]] == 1
    flows = {(p, t): min(copies[0][p], copies[1][t]) for p, t, _ in filter(alone, edges)}
    rest = [(p, t, (d << TIE_SHIFT) + _tie(p, t)) for p, t, d in edges if not alone((p, t))]
    if rest:
        flows |= _assign(rest, {p: copies[0][p] for p, _, _ in rest}, {t: copies[1][t] for _, t, _ in rest})
    distance = {(p, t): d for p, t, d in edges}
    # unit k of a flow is the next unused rank on both sides
    used, of_true = {}, {}
    for (p, t), flow in sorted(flows.items()):
        of_true[p, t] = used.get(t, 0)
        used[t] = used.get(t, 0) + flow
    used = {}
    for (p, t), flow in sorted(flows.items()):
        first = used.get(p, 0)
        used[p] = first + flow
        for k in range(flow):
            yield sides[0][p][first + k], sides[1][t][of_true[p, t] + k], distance[p, t]


def _block_matcher(names: list[str], per_panel: float):
    """In-task match over rows sorted by (comp, side, node, rank); one block is never cut."""
    def rows_of(table: pa.Table) -> pa.Table:
        comps, sides, nodes, known = (table[c].to_pylist() for c in ("comp", "side", "node", "known"))
        pred, true, distance = [], [], []
        start = 0
        for end in range(1, len(comps) + 1):
            if end < len(comps) and comps[end] == comps[start]:
                continue
            cut = start
            while cut < end and sides[cut] == 0:
                cut += 1
            left = {i: (i, None, None) for i in range(start, cut)}
            free = set(range(cut, end))
            if left and free:
                of = lambda a, b: [(i, nodes[i], known[i]) for i in range(a, b)]
                for i, j, d in _block_pairs(of(start, cut), of(cut, end), per_panel):
                    left[i] = (i, j, d)
                    free.discard(j)
            for i, j, d in [*left.values(), *((None, j, None) for j in free)]:
                pred.append(i)
                true.append(j)
                distance.append(d)
            start = end
        p, t = pa.array(pred, pa.int64()), pa.array(true, pa.int64())
        either = pa.array([j if i is None else i for i, j in zip(pred, true)], pa.int64())
        columns = {c: table[c].take(either) for c in names}
        for prefix, at in (("pred", p), ("true", t)):
            columns |= {f"{prefix}_panels": table["key_panels"].take(at), f"{prefix}_qty": table["qty"].take(at)}
        return pa.table(columns | {"d": pa.array(distance, pa.int64())})

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            comps = batch.column("comp").to_pylist()
            if kept and kept[-1].column("comp")[0].as_py() == comps[-1]:
                kept.append(batch)
                continue
            last = comps.index(comps[-1])  # the last block may go on in the next batch
            whole = pa.Table.from_batches([*kept, batch.slice(0, last)])
            kept = [batch.slice(last)]
            if whole.num_rows:
                yield from rows_of(whole).combine_chunks().to_batches()
        if kept:
            yield from rows_of(pa.Table.from_batches(kept)).combine_chunks().to_batches()
    return task


def _match_small(pred: DataFrame, true: DataFrame, scope: list[str], tau_in: float, bucket: float, mode: str) -> DataFrame:
    """Groups and matches units whose scopes are small: one shuffle, by scope."""
    rows = lambda df, side: df.select(F.lit(side).alias("side"), *scope, "kind", "panels", F.col("qty").cast("bigint").alias("qty"))
    both = rows(pred, 0).unionByName(rows(true, 1)).repartition(*scope)
    groups = with_key(both, bucket, mode).groupBy("side", *scope, "kind", "key_panels").agg(F.sum("qty").alias("qty"))
    named = _named(groups, scope, bucket)
    if tau_in == 0:
        # equal sizes of equal rank; scope columns come first, so that rows stay where they are
        same = Window.partitionBy(*scope, "block", "node", "side").orderBy("key_panels")
        of = lambda side: F.max(F.when(F.col("side") == side, F.struct("key_panels", "qty")))
        pairs = named.withColumn("rank", F.row_number().over(same)).groupBy(*scope, "block", "node", "rank").agg(of(0).alias("p"), of(1).alias("t"))
        ends = [F.col(c if c in scope else "block.kind").alias(f"{prefix}_{c}") for prefix in ("pred", "true") for c in (*scope, "kind")]
        return _matched(pairs.select(*ends, *[F.col(f"{s}.{c}").alias(f"{prefix}_{n}") for s, prefix in (("p", "pred"), ("t", "true"))
                                              for c, n in (("key_panels", "panels"), ("qty", "qty"))],
                                     F.lit(0).cast("bigint").alias("d")), scope, bucket)
    known = F.coalesce(~F.exists("dims", lambda v: v.isNull()), F.lit(False))
    ready = named.select(_block_text(F.col("block")).alias("comp"), "side", "node", known.alias("known"), *scope, "kind", "key_panels", "qty")
    kinds = {f.name: f.dataType for f in ready.schema}
    schema = StructType([StructField(c, kinds[c]) for c in (*scope, "kind")])
    for prefix in ("pred", "true"):
        schema = schema.add(f"{prefix}_panels", kinds["key_panels"]).add(f"{prefix}_qty", kinds["qty"])
    found = ready.sortWithinPartitions("comp", "side", "node", "key_panels").mapInArrow(
        _block_matcher([*scope, "kind"], tau_in / bucket), schema.add("d", LongType()))
    sides = [F.col(c).alias(f"{prefix}_{c}") for prefix in ("pred", "true") for c in (*scope, "kind")]
    return _matched(found.select(*sides, "pred_panels", "pred_qty", "true_panels", "true_qty", "d"), scope, bucket)


def match_units(pred: DataFrame, true: DataFrame, scope: list[str],
                tau_in: float = DEFAULT_TAU_IN, bucket: float = DEFAULT_BUCKET, mode: str = "full",
                max_local_edges: int = MAX_LOCAL_EDGES, bound_by: DataFrame | None = None) -> DataFrame:
    """Group both sides, then match.

    ``bound_by`` has at least as many rows per scope as each of the sides and is cheaper to count. Scopes with so few rows
    that their pairs cannot exceed ``max_local_edges`` are matched at once, the others by ``match_groups``.
    """
    grouped = lambda p, t: match_groups(group_units(p, scope, bucket, mode), group_units(t, scope, bucket, mode),
                                        scope, tau_in, bucket, max_local_edges)
    if bound_by is None:
        return grouped(pred, true)
    sizes = bound_by.groupBy(*scope).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > math.isqrt(max_local_edges))
    if sizes.isEmpty():
        return _match_small(pred, true, scope, tau_in, bucket, mode)
    large = stage(sizes.select(*[F.col(c).alias(f"_{c}") for c in scope]), "scopes")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in scope])
    part = lambda df, how: df.join(large, same, how)
    return _match_small(part(pred, "left_anti"), part(true, "left_anti"), scope, tau_in, bucket, mode).unionByName(
        grouped(part(pred, "left_semi"), part(true, "left_semi")))
