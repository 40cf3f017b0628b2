import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from fenestra.llm import bisector_clusters as b


def brute(rows, k=8, rounds=10, dimension=64, scale=1024, seed=3):
    """{(vec_id, vector): (cluster, distance, cluster_inertia, inertia, sha)} by plain integers and full distances."""
    kept = [(i, tuple(v)) for i, v in rows if v is not None and len(v) == dimension and all(x is not None and math.isfinite(x) for x in v)]
    points = [tuple(math.floor(scale * x) for x in v) for _, v in kept]
    name = lambda i: "~" if i is None else hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()
    order = sorted(range(len(kept)), key=lambda r: (name(kept[r][0]), kept[r][1]))
    centroids = [points[r] for r in order[:k]]
    near = lambda p: min((sum((x - y) ** 2 for x, y in zip(p, c)), i) for i, c in enumerate(centroids))
    for _ in range(rounds):
        groups = {}
        for p in points:
            groups.setdefault(near(p)[1], []).append(p)
        for c, own in groups.items():
            centroids[c] = tuple(sum(x) // len(own) for x in zip(*own))
    placed = [near(p) for p in points]
    inertia = [sum(d for d, c in placed if c == i) for i in range(k)]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((str(i), c, d, inertia[c], sum(inertia), sha[c]) for (i, _), (d, c) in zip(kept, placed))


def got(df):
    return sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 9), st.integers(1, 5), st.integers(0, 10_000), st.sampled_from([2, 100, 1 << 26, 1 << 80]))
def test_tournament_equals_all_distances(k, d, seed, size):
    rng = np.random.default_rng(seed)
    draw = lambda n: np.array([[int(x * size) for x in row] for row in rng.uniform(-1, 1, (n, d))], object)
    x, c = draw(20), draw(k)
    if size <= b._NARROW:
        x, c = x.astype(np.int64), c.astype(np.int64)
    distance = ((x[:, None, :].astype(object) - c[None, :, :].astype(object)) ** 2).sum(axis=2)
    assert b.tournament(x, *b.bisectors(c)).tolist() == [min(range(k), key=lambda j: (row[j], j)) for row in distance]


def test_query_equals_brute_force(spark, sf):
    from fenestra.llm.queries import all_queries

    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert got(all_queries()["op13_bisector_clusters"](spark, sf)) == brute(rows)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_awkward_vectors(spark, kind):
    rng = np.random.default_rng(5)
    rows = [(i, rng.integers(-3, 4, 4).astype(float).tolist()) for i in range(60)]
    rows += [(100 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(70)]  # one vector makes up more than a third
    rows += [(7, rows[7][1]), (7, [9.5, 0.001, -0.001, 2.0]), (None, [5.0, 5.0, 5.0, 5.0]), (301, None), (302, []), (303, [1.0, 2.0, 3.0]),
             (304, [1.0, None, 2.0, 3.0]), (305, [1.0, float("nan"), 2.0, 3.0]), (306, [1.0, float("inf"), 2.0, 3.0])]
    df = spark.createDataFrame([(i, v, "x", 1, 2) for i, v in rows], f"vec_id bigint, embedding array<{kind}>, cluster string, id int, vector int")
    plain = [(i, v if v is None else [x if x is None else float(np.float32(x)) if kind == "float" else x for x in v]) for i, v in rows]
    assert got(b.cluster(df.repartition(5), k=3, rounds=4, dimension=4)) == brute(plain, 3, 4, 4)


def test_large_components_are_exact(spark):
    rows = [(1, [1e30, 2.0]), (2, [1e30, 3.0]), (3, [-1e30, 0.5]), (4, [0.25, -0.25]), (5, [3e8, 1e8]), (6, [2e8, 1e8])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    for r, w in zip(got(b.cluster(df, k=2, rounds=3, dimension=2)), brute(rows, 2, 3, 2)):
        fits = lambda v: v if v < 1 << 63 else None
        assert r == (w[0], w[1], fits(w[2]), fits(w[3]), fits(w[4]), w[5])
    beyond = spark.createDataFrame([(1, [1e300, 1.0]), (2, [1.0, 1.0])], "vec_id bigint, embedding array<double>")
    assert [r.vec_id for r in b.cluster(beyond, dimension=2).collect()] == [2]


def test_few_and_no_vectors(spark):
    df = spark.createDataFrame([(1, [0.5, 0.5]), (2, [0.5, 0.5])], "vec_id bigint, embedding array<float>")
    assert got(b.cluster(df, dimension=2)) == brute([(1, [0.5, 0.5]), (2, [0.5, 0.5])], dimension=2)
    none = b.cluster(df.limit(0), dimension=2)
    assert none.count() == 0 and none.columns == b.cluster(df, dimension=2).columns
