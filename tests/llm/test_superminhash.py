import random
import string
from collections import defaultdict

import numpy as np
import pytest

from fenestra.llm import superminhash as s
from fenestra.llm.queries import all_queries

_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute(docs):
    """(id, text) -> {id: (set size, component)} by comparing all sets that share a shingle."""
    sets = defaultdict(list)
    for d, text in docs:
        words = s._WORD.findall((text or "").translate(_LOWER))
        sets[d].append(frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    rare = defaultdict(set)
    for d, own in sets.items():
        for one in own:
            for g in one:
                rare[g].add((d, one))
    for d, own in sets.items():
        for one in own:
            for e, other in set().union(*(rare[g] for g in one)) if one else ():
                if e < d and 100 * len(one & other) >= 85 * len(one | other):
                    a, b = find(d), find(e)
                    root[max(a, b)] = min(a, b)
    return {d: ({len(x) for x in own}, find(d)) for d, own in sets.items()}


def check(rows, docs):
    want = brute(docs)
    assert len(rows) == len(docs)
    for r in rows:
        assert r.n_shingles in want[r.doc_id][0] and r.component_id == want[r.doc_id][1], r
        assert r.kept == (r.doc_id == r.component_id)


def test_given_documents(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(all_queries()["op7_superminhash"](spark, sf).collect(), docs)


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return words


def test_planted_groups(spark, monkeypatch):
    monkeypatch.setattr(s, "BLOCK", 8)  # several blocks to a bucket
    rng = random.Random(3)
    docs, k = [], 0
    for g in range(25):
        words = [f"w{rng.randrange(5_000)}" for _ in range(rng.choice([7, 40, 120, 400]))]
        for _ in range(rng.choice([1, 2, 3, 30])):
            docs.append((k, " ".join(edited(rng, words, rng.randrange(0, 1 + len(words) // 30)))))
            k += 1
        if g % 4 == 0:  # a chain: each is near the one before, the ends are not near each other
            for _ in range(8):
                words = edited(rng, words, max(1, len(words) // 120))
                docs.append((k, " ".join(words)))
                k += 1
    passage = " ".join(f"p{i}" for i in range(60))
    docs += [(k + i, passage + " " + " ".join(f"x{i}_{j}" for j in range(30))) for i in range(40)]
    rng.shuffle(docs)
    check(s.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string")).collect(), docs)


@pytest.mark.parametrize("n,similarity", [(20, 0.9), (200, 0.5), (3_000, 0.85)])
def test_signature_estimates_with_less_variance(n, similarity):
    rng = np.random.default_rng(n)
    shared, errors = round(2 * n * similarity / (1 + similarity)), []
    for _ in range(60):
        a, b = (rng.integers(0, 1 << 63, n - shared, dtype=np.uint64) for _ in range(2))
        both = rng.integers(0, 1 << 63, shared, dtype=np.uint64)
        x, y = s.signatures([np.concatenate([both, a]), np.concatenate([both, b])])
        errors.append((x == y).mean() - shared / (2 * n - shared))
    assert abs(np.mean(errors)) < 0.012
    assert np.std(errors) < 1.1 * (similarity * (1 - similarity) / s.REGISTERS) ** 0.5


def test_signature_of_parts_is_that_of_the_whole(monkeypatch):
    x = np.random.default_rng(1).integers(0, 1 << 63, 500, dtype=np.uint64)
    whole = s.signatures([x, x[:3], x[:0]])
    monkeypatch.setattr(s, "CHUNK", 64)
    assert (s.signatures([x, x[:3], x[:0]]) == whole).all()


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 300)] + [(1_000, 1_000 + i) for i in range(1, 50)] + [(rng.randrange(2_000, 2_100), rng.randrange(2_000, 2_100)) for _ in range(90)]
    root = {x: x for e in edges for x in e}
    for _ in range(400):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.c: r.root for r in s.components(spark.createDataFrame(edges, "a bigint, b bigint").repartition(7)).collect()}
    assert got == {x: r for x, r in root.items() if x != r}


def test_awkward_documents(spark, awkward, no_documents):
    rows = s.near_duplicates(awkward).collect()
    assert len(rows) == awkward.count()
    by = {r.doc_id: r for r in rows}
    assert [by[k].component_id for k in (1, 2, 3, 4, 5, 7, 8)] == [1, 1, 1, 4, 5, 7, 8]
    assert by[4].n_shingles == by[5].n_shingles == by[8].n_shingles == 0 and by[7].n_shingles == 1
    assert by[None].component_id is None and by[None].kept
    assert s.near_duplicates(no_documents).count() == 0
    left = s.without_duplicates(awkward)
    assert left.schema == awkward.schema
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in left.collect()) == [(False, 0), *[(True, k) for k in (1, 4, 5, 6, 7, 8, 9)]]


def test_texts_of_one_id_count_together(spark):
    words = [f"w{i}" for i in range(50)]
    rows = [(5, " ".join(words)), (7, " ".join(words)), (7, "another text of the same id"), (9, "another text of the same id")]
    check(s.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect(), rows)


def test_one_row_of_a_repeated_id_stays(spark):
    words = " ".join(f"w{i}" for i in range(50))
    rows = [(5, words, 1), (5, words.upper() + " ", 2), (5, " ", 3), (5, None, 4), (7, words + " x", 5), (7, "b", 6),
            (8, "c", 7), (8, "c", 7), (9, None, 8), (9, "", 9), (None, "d", 10), (None, "d", 10)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, n bigint").repartition(5)
    left = s.without_duplicates(frame)
    assert left.schema == frame.schema
    assert sorted(map(tuple, left.collect()), key=str) == sorted(
        [(5, words.upper() + " ", 2), (8, "c", 7), (9, "", 9), (None, "d", 10), (None, "d", 10)], key=str)
