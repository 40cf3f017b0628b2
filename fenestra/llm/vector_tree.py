"""Approximate nearest neighbours by a hierarchical k-means tree with best-bin-first search.

* The tree is fitted on a bounded sample of distinct vectors (``SAMPLE``); every vector is indexed: it goes down to
  the leaf of the nearest centre at each level. Leaves hold about ``LEAF_ROWS`` vectors while the sample can
  tell so many leaves apart. Neighbouring leaves share a chunk of about ``CHUNK_ROWS`` vectors, a larger leaf gets
  several chunks; a chunk is what a task holds while the queries that visit one of its leaves stream by.
* A query goes through the tree with a priority queue of branches, the best inner product with a centre
  first, across levels, and visits the first leaves that come out.
* How many leaves is calibrated: a bounded number of queries is answered by brute force over all vectors, and
  the visits are widened until the wanted recall is reached. If all leaves are visited the search is exact.

Equal vectors are one class: only the smallest ids of a class can be among the nearest, so each class
is compared once, and a vector that makes up a third of the table costs no more than any other.

Nearness is the inner product, in double precision on the original values, summed in one fixed way for each pair; ties go to the
smaller id. Defined results: vectors that are null, empty, zero, or have null or non-finite components take
no part, nor do null ids and vectors of another length than most; a query has no row if there is no
candidate; an id with two different vectors is two candidates, a repeated (id, vector) is one; an
empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from fenestra.llm.common import ship
from fenestra.session import stage

ship(__name__)

SAMPLE = 32_768
BRANCHES = 64
LEAF_ROWS = 64
#: Queries answered by brute force to find the number of visits, and the recall to be reached by them.
CALIBRATION = 256
RECALL = 0.94
#: Vectors that a task holds, and queries that it compares with them at once.
CHUNK_ROWS = 8_192
QUERIES_AT_ONCE = 512
#: Queries of one chunk that go to one task; beyond it the chunk is sent to several tasks.
QUERIES_PER_TASK = 4_096


def usable(vector: Column) -> Column:
    """Not null, not empty, not zero, all components finite."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vector, lambda v: v != 0), F.lit(False))


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """Labels by Lloyd's rounds from spread-out starts; empty clusters are left out."""
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        labels = (0.5 * (centres ** 2).sum(axis=1) - x @ centres.T).argmin(axis=1)
        used = np.unique(labels)
        centres = np.array([x[labels == u].mean(axis=0) for u in used])
    return np.searchsorted(used, labels) if len(used) < k else labels


def fit(sample: np.ndarray, total: int, leaf_rows: int = LEAF_ROWS, branches: int = BRANCHES, seed: int = 3) -> dict[str, Any]:
    """The tree as arrays: centre of each node, its children, and the number of its leaf (-1 inside)."""
    rng = np.random.default_rng(seed)
    per_leaf = max(8.0, leaf_rows * len(sample) / max(total, 1))
    centres, children, leaf = [sample.mean(axis=0)], [[]], [-1]
    todo, leaves = [(0, sample)], 0
    while todo:
        node, own = todo.pop()
        k = min(branches, int(np.ceil(len(own) / per_leaf)))
        labels = _kmeans(own, k, rng) if k > 1 else np.zeros(len(own), int)
        if labels.max() == 0:
            leaf[node], leaves = leaves, leaves + 1
            continue
        for u in np.unique(labels):
            part = own[labels == u]
            children[node].append(len(centres))
            centres.append(part.mean(axis=0))
            children.append([])
            leaf.append(-1)
            todo.append((len(centres) - 1, part))
    return {"centres": np.array(centres), "children": [np.array(c, int) for c in children], "leaf": np.array(leaf), "leaves": leaves}


def leaves_of(tree: dict[str, Any], x: np.ndarray) -> np.ndarray:
    """The leaf each vector belongs to: down the nearest centres."""
    node = np.zeros(len(x), int)
    moving = np.arange(len(x)) if tree["leaf"][0] < 0 else np.empty(0, int)
    while len(moving):
        at = node[moving]
        for parent in np.unique(at):
            rows = moving[at == parent]
            kids = tree["children"][parent]
            c = tree["centres"][kids]
            node[rows] = kids[(0.5 * (c ** 2).sum(axis=1) - x[rows] @ c.T).argmin(axis=1)]
        moving = moving[tree["leaf"][node[moving]] < 0]
    return tree["leaf"][node]


def best_bins(tree: dict[str, Any], q: np.ndarray, visits: int) -> list[int]:
    """The first ``visits`` leaves that come out of the priority queue."""
    queue, out = [(0.0, 0)], []
    while queue and len(out) < visits:
        _, node = heapq.heappop(queue)
        if tree["leaf"][node] >= 0:
            out.append(int(tree["leaf"][node]))
            continue
        kids = tree["children"][node]
        for value, kid in zip((-(tree["centres"][kids] @ q)).tolist(), kids.tolist()):
            heapq.heappush(queue, (value, kid))
    return out


def _nearest(block: np.ndarray, ids: np.ndarray, queries: np.ndarray, visited: np.ndarray | None, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, positions, scores) of the k nearest rows of a block, nearest first.

    ``visited`` is a mask (queries, rows), or None for all. The matrix product finds the candidates; their
    scores are then summed in an order that does not depend on the place of a row in the block.
    """
    rough = queries @ block.T
    if visited is not None:
        rough[~visited] = -np.inf
    # no product and no sum is further from the true value than this, so every row of the k nearest is within twice of the k-th
    unsure = 4 * (block.shape[1] + 2) * np.finfo(np.float64).eps * np.linalg.norm(queries, axis=1) * np.linalg.norm(block, axis=1).max()
    least = np.partition(rough, len(ids) - k, axis=1)[:, len(ids) - k] if k < len(ids) else np.full(len(queries), -np.inf)
    for i, row in enumerate(rough):
        at = np.flatnonzero((row >= least[i] - unsure[i]) & (row > -np.inf))
        scores = (block[at] * queries[i]).sum(axis=1)
        order = np.lexsort((ids[at], -scores))[:k]
        if len(order):
            yield i, at[order], scores[order]


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of equal length without nulls as one array."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _indexed(classes: DataFrame, tree) -> DataFrame:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                leaf = leaves_of(tree.value, _matrix(batch.column(1)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf, pa.int32())], names=["cls", "vector", "leaf"])

    return classes.select("cls", "vector").mapInArrow(task, f"cls bigint, vector {classes.schema['vector'].dataType.simpleString()}, leaf int")


def _rows(found: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    """Column pieces put together."""
    columns = [np.concatenate(x) for x in zip(*found)] if found else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds)], names=names)


def brute_force(indexed: DataFrame, queries, k: int) -> DataFrame:
    """query, cls, leaf, score: each batch's k nearest for a bounded broadcast array of queries."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, qs = queries.value
        for batch in batches:
            found = []
            if batch.num_rows:
                own, leaf = batch.column(0).to_numpy(), batch.column(2).to_numpy()
                for i, at, scores in _nearest(_matrix(batch.column(1)), own, qs, None, k):
                    found.append((np.full(len(at), asked[i]), own[at], leaf[at], scores))
            yield _rows(found, ["query", "cls", "leaf", "score"], [pa.int64(), pa.int64(), pa.int32(), pa.float64()])

    return indexed.select("cls", "vector", "leaf").mapInArrow(task, "query bigint, cls bigint, leaf int, score double")


def top(rows: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """First k rows per key; tasks keep k rows per key before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def calibrated_visits(tree: dict[str, Any], truth: list[tuple[int, int]], queries: dict[int, np.ndarray], recall: float) -> tuple[int, float]:
    """(visits, recall): visits are widened until enough true neighbours (query, leaf) lie in visited leaves."""
    place = {q: {leaf: i for i, leaf in enumerate(best_bins(tree, v, tree["leaves"]))} for q, v in queries.items()}
    needed = np.bincount([place[q][leaf] for q, leaf in truth], minlength=tree["leaves"])
    reached = np.cumsum(needed) / max(1, needed.sum())
    visits = int(np.searchsorted(reached, recall)) + 1
    return min(visits, tree["leaves"]), float(reached[min(visits, tree["leaves"]) - 1])


def chunks_of(sizes: dict[int, int], leaves: int) -> tuple[np.ndarray, np.ndarray]:
    """First chunk and number of chunks of each leaf; leaves in order share chunks of even size, a larger leaf has several of its own."""
    counts = np.array([sizes.get(leaf, 0) for leaf in range(leaves)], np.int64)
    parts = np.maximum(1, -(-counts // CHUNK_ROWS))
    small = np.where(parts == 1, counts, 0)
    chunks = max(1, -(-small.sum() // CHUNK_ROWS))
    even = max(1.0, small.sum() / chunks)
    place = np.minimum((np.cumsum(small) - small / 2) // even, chunks - 1).astype(np.int64)
    own = place[parts == 1].max(initial=-1) + 1  # the first chunk of the large leaves
    first = np.where(parts == 1, place, own + np.cumsum(np.where(parts > 1, parts, 0)) - parts)
    return first, parts


def _visits(asked: DataFrame, shared, where, visits: int) -> DataFrame:
    """A row per query and chunk, with the leaves of the chunk that the query visits."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, count = where.value
        for batch in batches:
            rows, chunks, leaves = [], [], []
            for i, q in enumerate(_matrix(batch.column(1)) if batch.num_rows else ()):
                by: dict[int, list[int]] = {}
                for leaf in best_bins(shared.value, q, visits):
                    for c in range(first[leaf], first[leaf] + count[leaf]):
                        by.setdefault(c, []).append(leaf)
                rows += [i] * len(by)
                chunks += by.keys()
                leaves += by.values()
            picked = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(chunks, pa.int32()), batch.column(0).take(picked), batch.column(1).take(picked),
                 pa.array(leaves, pa.list_(pa.int32()))], names=["chunk", "cls", "vector", "leaves"])

    kind = asked.schema["vector"].dataType.simpleString()
    return asked.select("cls", "vector").mapInArrow(task, f"chunk int, cls bigint, vector {kind}, leaves array<int>")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], int, pa.RecordBatch]]:
    """((chunk, salt), side, rows) of a partition sorted by these; a chunk's queries may come in many pieces."""
    for batch in batches:
        keys = np.stack([batch.column(i).to_numpy() for i in (0, 5, 1)], axis=1)
        ends = [*(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1), len(keys)]
        for start, end in zip([0, *ends], ends):
            if end > start:
                yield (int(keys[start, 0]), int(keys[start, 1])), int(keys[start, 2]), batch.slice(start, end - start)


def _searched(dealt: DataFrame, k: int) -> DataFrame:
    """query, cls, score: the k nearest of each chunk for each of its queries."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, parts, block = None, [], None
        for chunk, side, rows in _pieces(batches):
            if chunk != held:
                held, parts, block = chunk, [], None
            if side == 0:
                parts.append((rows.column(2).to_numpy(), _matrix(rows.column(3)), rows.column(4).flatten().to_numpy()))
                continue
            if block is None and parts:
                block, parts = tuple(np.concatenate(x) for x in zip(*parts)), []
            found = []
            for start in range(0, rows.num_rows if block else 0, QUERIES_AT_ONCE):
                part = rows.slice(start, QUERIES_AT_ONCE)
                ids, vectors, leaf = block
                seen = np.zeros((part.num_rows, int(leaf.max()) + 1), bool)
                for i, leaves in enumerate(part.column(4).to_pylist()):
                    seen[i, [x for x in leaves if x < seen.shape[1]]] = True
                asked = part.column(2).to_numpy()
                for i, at, scores in _nearest(vectors, ids, _matrix(part.column(3)), seen[:, leaf], k):
                    found.append((np.full(len(at), asked[i]), ids[at], scores))
            yield _rows(found, ["query", "cls", "score"], [pa.int64(), pa.int64(), pa.float64()])

    return dealt.mapInArrow(task, "query bigint, cls bigint, score double")


def search(vectors: DataFrame, is_query: Column | str, k: int = 20, recall: float = RECALL, id_col: str = "vec_id",
           vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for every row where ``is_query`` holds.

    ``is_query`` is an expression over the columns of ``vectors``, a Column or SQL.
    """
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    raw = F.col(f"`{vector_col}`")
    is_query = F.expr(is_query) if isinstance(is_query, str) else is_query
    rows = vectors.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), raw.alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks")).where(
        F.col("id").isNotNull() & usable(raw))
    lengths = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not lengths:
        return empty
    rows = rows.where(F.size("vector") == lengths[0]["n"]).withColumn("h1", F.xxhash64("vector")).withColumn(
        "h2", F.xxhash64(F.lit(1), "vector"))

    # classes of equal vectors, named by their smallest id
    names = rows.groupBy("h1", "h2").agg(F.min("id").alias("cls"))
    points = stage(rows.select("id", "asks", "h1", "h2").join(names, ["h1", "h2"]).select("id", "asks", "cls").distinct(), "points")
    first = rows.groupBy("h1", "h2").agg(F.min_by("vector", "id").alias("vector"), F.min("id").alias("cls"))
    classes = stage(first.select("cls", "vector", "h1"), "classes")
    total = classes.count()
    asked = stage(points.where("asks").select("cls").distinct().join(classes, "cls"), "asked")

    sample = np.array([r["vector"] for r in classes.orderBy("h1", "cls").limit(SAMPLE).select("vector").collect()], np.float64)
    tree = fit(sample, total)
    shared = spark.sparkContext.broadcast(tree)
    indexed = stage(_indexed(classes, shared), "index")

    probe = {r["cls"]: np.array(r["vector"], np.float64) for r in asked.orderBy("h1", "cls").limit(CALIBRATION).collect()}
    if not probe:
        return empty
    sent = spark.sparkContext.broadcast((list(probe), np.array(list(probe.values()))))
    best = top(brute_force(indexed, sent, k + 1), ["query"], [F.desc("score"), F.col("cls")], k + 1)
    truth = [(r["query"], r["leaf"]) for r in best.select("query", "leaf").collect()]
    visits, _ = calibrated_visits(tree, truth, probe, recall)

    # as many rows as the tree has leaves
    sizes = {r["leaf"]: r["count"] for r in indexed.groupBy("leaf").count().collect()}
    first, count = chunks_of(sizes, tree["leaves"])
    where = spark.sparkContext.broadcast((first, count))
    at = spark.createDataFrame([(leaf, int(first[leaf]), int(count[leaf])) for leaf in sizes], "leaf int, first int, parts int")
    held = indexed.join(at, "leaf").select(
        (F.col("first") + F.pmod(F.xxhash64("cls"), F.col("parts"))).cast("int").alias("chunk"), F.lit(0).alias("side"), "cls", "vector",
        F.array("leaf").alias("leaves"))
    salts = -(-asked.count() // QUERIES_PER_TASK)  # no chunk is visited by more than all queries
    copies = held.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))) if salts > 1 else held.withColumn("salt", F.lit(0))
    wanted = _visits(asked, shared, where, visits).select("chunk", F.lit(1).alias("side"), "cls", "vector", "leaves",
                                                         F.pmod(F.xxhash64("cls"), F.lit(salts)).cast("int").alias("salt"))
    dealt = copies.unionByName(wanted).repartition("chunk", "salt").sortWithinPartitions("chunk", "salt", "side").select(
        "chunk", "side", "cls", "vector", "leaves", "salt")
    near = top(_searched(dealt, k + 1), ["query"], [F.desc("score"), F.col("cls")], k + 1).drop("rank")

    # classes to ids: the smallest k + 1 of a class are enough; then the queries' own ids go
    members = top(points.select("cls", "id").distinct(), ["cls"], [F.col("id")], k + 1).drop("rank")
    ids = top(near.join(members, "cls"), ["query"], [F.desc("score"), F.col("id")], k + 1).drop("rank", "cls")
    ids = stage(ids, "neighbours")
    pairs = points.where("asks").select(F.col("id").alias("query_id"), F.col("cls").alias("query")).join(ids, "query").where("id != query_id")
    return top(pairs, ["query_id", "query"], [F.desc("score"), F.col("id")], k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")
