"""Drop repeated detections: same spec group, overlapping boxes, first one stays.

Order matters: a detection goes if it overlaps an earlier one *that stayed*.
Small groups are walked in order inside tasks. Large ones are decided in rounds
of joins: a box that is the earliest undecided one in every grid cell it touches
stays, everything it overlaps goes. A round joins undecided boxes to at most one
new box per cell, so no pairs within a group are listed.
Where a count shows scopes to be so small that a task may hold each of them, units are
shuffled once, by scope, and walked and merged there; the result is the same.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import LongType

from fenestra.functions.geometry import iou
from fenestra.operators.spec_groups import DEFAULT_BUCKET, with_key
from fenestra.session import stage

# the in-task function travels with the plan; executors need no installed copy
cloudpickle.register_pickle_by_value(sys.modules[__name__])

THRESHOLD = 0.4
#: Detections of one group that a task may walk.
MAX_LOCAL_ROWS = 2_000
_BOX = ("page", "x", "y", "w", "h")


def _boxes(page_scoped: bool) -> Column:
    page = lambda e: F.coalesce(e["page"], F.lit(0)) if page_scoped else F.lit(0)
    given = F.filter("evidence", lambda e: e["bbox"].isNotNull())
    return F.transform(given, lambda e: F.struct(
        page(e).alias("page"), *[e["bbox"][n].alias(n) for n in "xywh"]))


def _walker(threshold: float):
    """In-task greedy walk over rows sorted by (group, order)."""
    def overlaps(boxes: np.ndarray, kept: np.ndarray) -> np.ndarray:
        a, b = boxes[:, None, :], kept[None, :, :]
        right = np.minimum(a[..., 1] + a[..., 3], b[..., 1] + b[..., 3]) - np.maximum(a[..., 1], b[..., 1])
        down = np.minimum(a[..., 2] + a[..., 4], b[..., 2] + b[..., 4]) - np.maximum(a[..., 2], b[..., 2])
        common = np.maximum(right, 0) * np.maximum(down, 0)
        union = a[..., 3] * a[..., 4] + b[..., 3] * b[..., 4] - common
        share = np.divide(common, union, out=np.zeros_like(common), where=union > 0)
        return ((share > threshold) & (a[..., 0] == b[..., 0])).any(axis=0)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, kept, owners, n = None, np.empty((64, 5)), [], 0
        for batch in batches:
            parents = []
            for g, rid, boxes in zip(batch["grp"], batch["rid"], batch["flat"]):
                if g != group:
                    group, owners, n = g, [], 0
                mine = np.asarray(boxes, dtype=float).reshape(-1, 5)
                parent = rid
                if len(mine) and n:
                    hit = overlaps(mine, kept[:n])
                    if hit.any():
                        parent = owners[int(np.argmax(hit))]
                if parent == rid and len(mine):
                    while n + len(mine) > len(kept):
                        kept = np.concatenate([kept, np.empty_like(kept)])
                    kept[n:n + len(mine)] = mine
                    n += len(mine)
                    owners.extend([rid] * len(mine))
                parents.append(parent)
            yield pd.DataFrame({"rid": batch["rid"], "parent": parents})
    return walk


def _cells(nodes: DataFrame, threshold: float) -> DataFrame:
    """Grid cells of every box, at its own size level and the next one.

    Boxes that overlap beyond the threshold have sizes within a factor of
    1/threshold, so they share a cell on the larger one's level; a box touches at
    most four cells per level, however large it is.
    """
    base = max(2.0, float(np.ceil(1 / threshold)))
    level = lambda side: F.floor(F.log(base, side)).cast("bigint")
    flat = nodes.select("grp", "node", "seq", F.explode("boxes").alias("b")).where(
        (F.col("b.w") > 0) & (F.col("b.h") > 0))
    out = flat.withColumn("lw", F.explode(F.sequence(level(F.col("b.w")), level(F.col("b.w")) + 1))).withColumn(
        "lh", F.explode(F.sequence(level(F.col("b.h")), level(F.col("b.h")) + 1)))
    for axis, side, lvl in (("x", "w", "lw"), ("y", "h", "lh")):
        size = F.pow(F.lit(base), F.col(lvl) + 1)
        at = lambda v: F.floor(v / size).cast("bigint")
        out = out.withColumn(f"c{axis}", F.explode(F.sequence(
            at(F.col(f"b.{axis}")), at(F.col(f"b.{axis}") + F.col(f"b.{side}")))))
    return out.select("grp", "node", "seq", F.col("b.page").alias("page"), "lw", "lh", "cx", "cy",
                      "b").distinct()


_CELL = ["grp", "page", "lw", "lh", "cx", "cy"]


def _overlapping(cells: DataFrame, kept: DataFrame, threshold: float) -> DataFrame:
    """(node, kept node, kept seq) pairs in a common cell that overlap, earlier one kept."""
    other = kept.select(*_CELL, F.col("node").alias("k_node"), F.col("seq").alias("k_seq"),
                        F.col("b").alias("k_b"))
    return cells.join(other, _CELL).where(
        (F.col("k_seq") < F.col("seq")) & (iou(F.col("b"), F.col("k_b")) > threshold)).select(
        "grp", "node", "k_node", "k_seq")


def _decide_distributed(rows: DataFrame, threshold: float) -> DataFrame:
    """(rid, parent) for groups of any size."""
    rows = stage(rows, "detections")
    solid = F.exists("boxes", lambda b: (b["w"] > 0) & (b["h"] > 0))
    alone = rows.where(~solid).select("rid", F.col("rid").alias("parent"))
    # equal detections share their fate, so they become one node
    nodes = stage(rows.where(solid).groupBy("grp", "boxes").agg(
        F.min("seq").alias("seq"), F.min_by("rid", "seq").alias("node")), "nodes")
    cells = stage(_cells(nodes, threshold), "cells")
    undecided, kept = cells, None
    while True:
        lead = undecided.groupBy(*_CELL).agg(F.min("seq").alias("_first"))
        new = undecided.join(lead, _CELL).groupBy("grp", "node").agg(
            F.bool_and(F.col("seq") == F.col("_first")).alias("stays")).where("stays").select("grp", "node")
        new = stage(new, "kept")
        new_cells = undecided.join(new, ["grp", "node"], "left_semi")
        gone = _overlapping(undecided, new_cells, threshold).select("grp", "node").unionByName(new).distinct()
        undecided = stage(undecided.join(gone, ["grp", "node"], "left_anti"), "undecided")
        kept = new if kept is None else kept.unionByName(new)
        if undecided.isEmpty():
            break
    kept = stage(kept, "kept")
    owner = _overlapping(cells.join(kept, ["grp", "node"], "left_anti"),
                         cells.join(kept, ["grp", "node"], "left_semi"), threshold).groupBy(
        "grp", "node").agg(F.min_by("k_node", "k_seq").alias("parent"))
    named = nodes.join(owner, ["grp", "node"], "left").select(
        "grp", "boxes", F.coalesce("parent", "node").alias("parent"))
    return rows.where(solid).select("grp", "boxes", "rid").join(named, ["grp", "boxes"]).select(
        "rid", "parent").unionByName(alone)


def overlap_pairs(boxes: DataFrame, scope: list[str], row_id: str, box: str,
                  threshold: float = THRESHOLD) -> DataFrame:
    """Pairs of boxes of one scope that overlap beyond the threshold: a_id < b_id, iou.

    Only boxes in a common grid cell are compared.
    """
    nodes = boxes.select(F.to_json(F.struct(*scope)).alias("grp"), F.col(row_id).alias("node"),
                         F.col(row_id).alias("seq"), *scope,
                         F.array(F.struct(F.lit(0).alias("page"), *[F.col(box)[n].alias(n) for n in "xywh"]))
                         .alias("boxes"))
    cells = _cells(nodes.select("grp", "node", "seq", "boxes"), threshold)
    other = cells.select(*_CELL, F.col("node").alias("a_id"), F.col("b").alias("a"))
    pairs = cells.join(other, _CELL).where((F.col("a_id") < F.col("node")) & (iou(F.col("a"), F.col("b")) > threshold))
    found = pairs.select("a_id", F.col("node").alias("b_id"), iou(F.col("a"), F.col("b")).alias("iou")).distinct()
    return nodes.select(*scope, F.col("node").alias("a_id")).join(found, "a_id")


def owners(units: DataFrame, scope: list[str], order: list[str], threshold: float = THRESHOLD,
           page_scoped: bool = True, bucket: float = DEFAULT_BUCKET,
           max_local_rows: int = MAX_LOCAL_ROWS) -> DataFrame:
    """Add ``rid`` and ``parent``: the detection that each one is merged into (itself if it stays).

    Detections of equal ``order`` follow each other by confidence and quantity.
    ``page_scoped=False`` also merges equal positions on different pages.
    """
    again = Window.partitionBy(*scope, *order).orderBy("confidence", "qty", "kind")
    keyed = with_key(units, bucket).withColumn("_again", F.row_number().over(again)).withColumns({
        "grp": _group(scope),
        "rid": F.to_json(F.struct(*scope, *order, "_again")), "seq": F.struct(*order, "_again"),
        "boxes": _boxes(page_scoped)}).drop("_again")
    keyed = stage(keyed, "keyed")
    rows = keyed.select("grp", "rid", "seq", "boxes")
    sizes = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    walked = lambda r: r.withColumn("flat", _flat(F.col("boxes"))).select("grp", "seq", "rid", "flat").repartition(
        "grp").sortWithinPartitions("grp", "seq").select("grp", "rid", "flat").mapInPandas(
        _walker(threshold), "rid string, parent string")
    if sizes.where(F.col("n") > max_local_rows).isEmpty():
        decided = walked(rows)
    else:
        sized = rows.join(sizes, "grp")
        decided = walked(sized.where(F.col("n") <= max_local_rows)).unionByName(
            _decide_distributed(sized.where(F.col("n") > max_local_rows).drop("n"), threshold))
    return keyed.join(decided, "rid").drop("grp", "boxes", "key_panels")


def _parents(group: np.ndarray, of: np.ndarray, boxes: np.ndarray, n_rows: int, threshold: float) -> np.ndarray:
    """Row that each of ``n_rows`` rows in order is merged into; ``group`` and ``of`` are the group and the row of each box.

    Boxes are compared with the next one, the one after it and so on, those of all groups at once.
    """
    parents, hits = np.arange(n_rows), {}
    page, x, y, w, h = boxes.T
    at, away = np.arange(len(boxes)), 1
    while True:
        at = at[at + away < len(boxes)]
        at = at[group[at] == group[at + away]]
        if not len(at):
            break
        a, b = at, at + away
        right = np.minimum(x[a] + w[a], x[b] + w[b]) - np.maximum(x[a], x[b])
        down = np.minimum(y[a] + h[a], y[b] + h[b]) - np.maximum(y[a], y[b])
        common = np.maximum(right, 0) * np.maximum(down, 0)
        union = w[a] * h[a] + w[b] * h[b] - common
        share = np.divide(common, union, out=np.zeros_like(common), where=union > 0)
        hit = (share > threshold) & (page[a] == page[b]) & (of[a] < of[b])
        for earlier, later in zip(of[a[hit]].tolist(), of[b[hit]].tolist()):
            hits.setdefault(later, []).append(earlier)
        away += 1
    for row in sorted(hits):
        parents[row] = min((k for k in hits[row] if parents[k] == k), default=row)
    return parents


def _merger(threshold: float, names: list[str]):
    """In-task walk over whole groups, rows sorted by (group, order): those that stay, with what was merged into them."""
    def height(confidence) -> tuple:
        return (0, 0.0) if confidence is None else (2, 0.0) if confidence != confidence else (1, confidence)

    def merged(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        grp = table["grp"]
        first = pc.not_equal(grp.slice(1), grp.slice(0, len(grp) - 1)).to_numpy()
        group = np.concatenate([[0], np.cumsum(first)])
        sizes = pc.fill_null(pc.list_value_length(table["flat"]), 0).to_numpy() // len(_BOX)
        boxes = np.asarray(pc.list_flatten(table["flat"]).to_numpy(), dtype=float).reshape(-1, len(_BOX))
        of = np.repeat(np.arange(len(grp)), sizes)
        parents = _parents(group[of], of, boxes, len(grp), threshold)
        own = parents == np.arange(len(grp))
        stays = np.flatnonzero(own)
        kept = table.select([*names, "confidence", "qty"]).take(pa.array(stays))
        columns = {c: kept[c] for c in kept.column_names} | {"n_merged": pa.array(np.bincount(parents)[stays], pa.int64())}
        if len(stays) < len(grp):
            place = dict(zip(stays.tolist(), range(len(stays))))
            best, most = kept["confidence"].to_pylist(), kept["qty"].to_pylist()
            gone = np.flatnonzero(~own)
            others = table.select(["confidence", "qty"]).take(pa.array(gone)).to_pydict()
            for owner, confidence, qty in zip(parents[gone].tolist(), others["confidence"], others["qty"]):
                k = place[owner]
                if height(confidence) > height(best[k]):
                    best[k] = confidence
                    if qty is not None and (most[k] is None or qty > most[k]):
                        most[k] = qty
            columns |= {c: pa.array(v, table.schema.field(c).type) for c, v in (("confidence", best), ("qty", most))}
        return pa.table(columns)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            groups = batch.column("grp").to_pylist()
            if kept and kept[-1].column("grp")[0].as_py() == groups[-1]:
                kept.append(batch)
                continue
            last = groups.index(groups[-1])  # the last group may go on in the next batch
            whole = pa.Table.from_batches([*kept, batch.slice(0, last)])
            kept = [batch.slice(last)]
            if whole.num_rows:
                yield from merged(whole).combine_chunks().to_batches()
        if kept:
            yield from merged(pa.Table.from_batches(kept)).combine_chunks().to_batches()
    return task


def _group(scope: list[str]) -> Column:
    return F.to_json(F.struct(*scope, "kind", "key_panels"))


def _flat(boxes: Column) -> Column:
    return F.flatten(F.transform(boxes, lambda b: F.array(*[b[n].cast("double") for n in _BOX])))


def _dedup_small(units: DataFrame, scope: list[str], order: list[str], threshold: float, page_scoped: bool,
                 bucket: float) -> DataFrame:
    """``dedup_overlaps`` where a task may hold each scope: one shuffle, by scope."""
    names = [c for c in units.columns if c not in ("confidence", "qty")]
    keyed = with_key(units.repartition(*scope), bucket).withColumns({
        "grp": _group(scope), "flat": _flat(_boxes(page_scoped))}).drop("key_panels")
    # detections of equal order follow each other by confidence and quantity; their kind is in the group
    rows = keyed.sortWithinPartitions("grp", *order, "confidence", "qty")
    kinds = {f.name: f for f in units.schema}
    schema = units.select(*names).schema.add("confidence", kinds["confidence"].dataType).add("qty", kinds["qty"].dataType)
    return rows.mapInArrow(_merger(threshold, names), schema.add("n_merged", LongType()))


def dedup_overlaps(units: DataFrame, scope: list[str], order: list[str], threshold: float = THRESHOLD,
                   page_scoped: bool = True, bucket: float = DEFAULT_BUCKET,
                   max_local_rows: int = MAX_LOCAL_ROWS, bound_by: DataFrame | None = None) -> DataFrame:
    """Units that stay, with confidence and quantity raised by what was merged into them.

    A merged detection counts only if it is more confident than everything merged
    before it; its quantity then competes for the maximum. Such a record is the
    first of its confidence and comes before every more confident one, which is
    read off after reducing each owner to its distinct confidences.

    ``bound_by`` has at least as many rows per scope and is cheaper to count: scopes that a task may walk
    are shuffled once and merged where they are walked.
    """
    if bound_by is not None:
        sizes = bound_by.groupBy(*scope).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > max_local_rows)
        if sizes.isEmpty():
            return _dedup_small(units, scope, order, threshold, page_scoped, bucket)
        large = stage(sizes.select(*[F.col(c).alias(f"_{c}") for c in scope]), "scopes")
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in scope])
        rest = dedup_overlaps(units.join(large, same, "left_semi"), scope, order, threshold, page_scoped, bucket, max_local_rows)
        return _dedup_small(units.join(large, same, "left_anti"), scope, order, threshold, page_scoped, bucket).unionByName(rest)
    owned = stage(owners(units, scope, order, threshold, page_scoped, bucket, max_local_rows), "owned")
    firsts = owned.groupBy("parent", "confidence").agg(
        F.min("seq").alias("seq"), F.min_by("qty", "seq").alias("qty"), F.count(F.lit(1)).alias("n"))
    above = Window.partitionBy("parent").orderBy(F.col("confidence").desc()).rowsBetween(
        Window.unboundedPreceding, -1)
    earlier = F.min("seq").over(above)
    merged = firsts.withColumn("record", earlier.isNull() | (F.col("seq") < earlier)).groupBy("parent").agg(
        F.max("confidence").alias("confidence"), F.max(F.when(F.col("record"), F.col("qty"))).alias("qty"),
        F.sum("n").alias("n_merged"))
    kept = owned.where(F.col("rid") == F.col("parent")).drop("confidence", "qty", "seq", "rid")
    return kept.join(merged, "parent").drop("parent")
