from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from fenestra.llm import vector_tree as t
from fenestra.llm.queries import all_queries

ASKS = "vec_id % 20 = 0"


def brute(points, k=20):
    """query -> [(id, score)] by the definition, for (id, vector) pairs."""
    ids, x = np.array([p[0] for p in points]), np.array([p[1] for p in points], np.float64)
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        scores = (x * x[i]).sum(axis=1)
        order = [j for j in np.lexsort((ids, -scores)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), float(scores[j])) for j in order]
    return out


def found(rows):
    by = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        by[r.query_id].append((r.vec_id, r.score))
        assert r.rank == len(by[r.query_id])
    return by


def test_recall_and_scores_on_all_vectors(spark, sf):
    points = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want, got = brute(points), found(all_queries()["op6_kmeans_tree"](spark, sf).collect())
    assert set(want) == set(got) and all(len(got[q]) == len(want[q]) for q in want)
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    exact = {(q, v): s for q in want for v, s in want[q]}
    assert all(abs(exact.get((q, v), s) - s) < 1e-12 for q in got for v, s in got[q])


def test_all_leaves_give_the_exact_answer(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(700, 8)).round(2)
    points = [(i, base[i % 700 if i % 3 else 0].tolist()) for i in range(1_500)]  # one vector has a third of all rows
    df = spark.createDataFrame(points, "vec_id bigint, embedding array<double>")
    got = found(t.search(df, ASKS, recall=1.0).collect())
    want = brute(points)
    assert {q: [v for v, _ in r] for q, r in got.items()} == {q: [v for v, _ in r] for q, r in want.items()}


def test_small_chunks_and_batches(spark, monkeypatch):
    monkeypatch.setattr(t, "CHUNK_ROWS", 50)
    monkeypatch.setattr(t, "QUERIES_AT_ONCE", 3)
    rng = np.random.default_rng(5)
    points = [(i, rng.normal(size=6).tolist()) for i in range(400)]
    got = found(t.search(spark.createDataFrame(points, "vec_id bigint, embedding array<float>"), ASKS, recall=1.0).collect())
    want = brute([(i, np.float32(v).tolist()) for i, v in points])
    assert {q: [v for v, _ in r] for q, r in got.items()} == {q: [v for v, _ in r] for q, r in want.items()}


def test_visits_are_widened_until_the_recall_is_reached():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3_000, 16))
    tree = t.fit(x, len(x))
    leaf = t.leaves_of(tree, x)
    assert set(leaf.tolist()) == set(range(tree["leaves"]))
    queries = {i: x[i] for i in range(0, 3_000, 100)}
    truth = [(i, leaf[j]) for i, q in queries.items() for j in np.argsort(-(x @ q))[:20]]
    visits, reached = t.calibrated_visits(tree, truth, queries, 0.9)
    share = lambda n: np.mean([leaf in t.best_bins(tree, queries[i], n) for i, leaf in truth])
    assert reached == share(visits) >= 0.9 > share(visits - 1)


def test_awkward_vectors(spark):
    rows = [(0, [1.0, 2.0]), (20, [1.0, 2.0]), (3, [0.0, 0.0]), (4, None), (5, []), (6, [1.0, None]), (7, [float("nan"), 1.0]),
            (8, [float("inf"), 1.0]), (None, [1.0, 1.0]), (9, [1.0, 2.0, 3.0]), (1, [3.0, 1.0]), (1, [3.0, 1.0]), (40, [-0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("score", F.lit("other"))
    got = found(t.search(df, ASKS).collect())
    assert dict(got) == {0: [(1, 5.0), (20, 5.0), (40, 2.0)], 20: [(0, 5.0), (1, 5.0), (40, 2.0)], 40: [(0, 2.0), (20, 2.0), (1, 1.0)]}
    assert t.search(df.limit(0), ASKS).count() == 0
    assert t.search(df.where("vec_id = 0"), ASKS).count() == 0


def test_ties_go_to_the_smaller_id():
    rng = np.random.default_rng(8)
    block = np.concatenate([np.ones((400, 1)), rng.normal(size=(400, 3))], axis=1)  # distinct vectors of equal product with the query
    ids = rng.permutation(400) + 1
    for k in (1, 21, 399, 400, 500):
        (_, at, scores), = t._nearest(block, ids, np.array([[2.0, 0.0, 0.0, 0.0]]), None, k)
        assert ids[at].tolist() == list(range(1, min(k, 400) + 1)) and set(scores) == {2.0}
    seen = np.zeros((1, 400), bool)
    seen[0, :30] = True
    (_, at, _), = t._nearest(block, ids, np.array([[2.0, 0.0, 0.0, 0.0]]), seen, 21)
    assert ids[at].tolist() == sorted(ids[:30].tolist())[:21]


def test_quantised_vectors_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(t, "CHUNK_ROWS", 200)
    monkeypatch.setattr(t, "QUERIES_PER_TASK", 7)
    rng = np.random.default_rng(9)
    points = [(i, v) for i, v in enumerate(rng.integers(-1, 2, (900, 5)).astype(float).tolist())]
    points += [(1_000 + i, [float(j == i % 9) for j in range(5)]) for i in range(200)]  # one-hot, many of them zero
    df = spark.createDataFrame(points, "vec_id bigint, embedding array<float>")
    want = brute([p for p in points if any(p[1])])
    assert dict(found(t.search(df, ASKS, recall=1.0).collect())) == want


def test_chunks_are_even():
    sizes = {leaf: 100 + leaf % 7 for leaf in range(300)}
    first, count = t.chunks_of(sizes, 300)
    rows = np.bincount(first, [sizes[i] for i in range(300)])
    assert (count == 1).all() and rows.max() < 1.1 * rows.min() and rows.max() <= t.CHUNK_ROWS
    first, count = t.chunks_of({0: 10, 1: 3 * t.CHUNK_ROWS, 2: 20, 3: t.CHUNK_ROWS + 1}, 5)
    assert count.tolist() == [1, 3, 1, 2, 1] and first[1] == 1 and first[3] == 4 and first[0] == first[2] == first[4] == 0
