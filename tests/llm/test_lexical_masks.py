import math
import re
import string
from collections import Counter

import numpy as np
import pytest

from fenestra.llm import lexical_masks as m

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=50):
    """{item: [(id, score)]}: every document scored for every item."""
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n, total = len(counts), sum(sum(c.values()) for _, c in counts)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    df = Counter(t for _, c in counts for t in c)
    out = {}
    for item, own in asked.items():
        found = []
        for i, c in counts:
            length = 100 - 50 + (50 * sum(c.values()) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 20 * length))
                        for t in own if c[t])
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        if found:
            out[item] = [(i, -s) for s, _, _, i in sorted(found, key=lambda x: x[:3])[:k]]
    return out


def got(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (str(r.item_id), r.rank)):
        assert r.rank == len(out.setdefault(r.item_id, [])) + 1
        out[r.item_id].append((r.doc_id, r.score))
    return out


def test_terms():
    text = "Ünï-CÖDé 42nd \x00a\x7fb_c `d` 日本,語 ÀÉ"
    assert [t.decode() for t in m.terms(text.encode())] == terms(text) and m.terms(None) == []


@pytest.mark.parametrize("width", [1, 8, 9, 64, 65, 130])
def test_masks_group_equal_rows(width):
    present = np.random.default_rng(width).random((300, width)) < 0.5
    present[100:200] = present[:100]
    first, group, count = m.masks_of(present)
    assert (present[first][group] == present).all() and count.sum() == 300
    assert len(first) == len({tuple(r) for r in present.tolist()})


@pytest.mark.parametrize("blocks", [1, 5])
def test_equals_brute_force(spark, sf, monkeypatch, blocks):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    if blocks > 1:
        monkeypatch.setattr(m, "BLOCK_TERMS", 300)
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    assert got(m.search(frame, spark.createDataFrame(items, "item_id bigint, text string"), 20)) == brute(docs, items, 20)


def test_hot_words_ties_and_copies(spark, monkeypatch):
    monkeypatch.setattr(m, "GROUP_DOCS", 64)
    monkeypatch.setattr(m, "GROUP_POSTINGS", 200)
    docs = [(i, "the common words") for i in range(300, 0, -1)]  # one text makes up most of the table
    docs += [(1000 + i, f"the word{i % 7} " + "filler " * (i % 5) + f"word{i % 3}") for i in range(200)]
    items = [(1, "the common words"), (2, "word1 WORD2 the"), (3, "nothing known"), (4, " ".join(f"word{i} pad{i}" for i in range(90)))]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)
    want = brute(docs, items)
    assert got(m.search(frame, spark.createDataFrame(items, "item_id bigint, text string"))) == want and set(want) == {1, 2, 4}


def test_the_bound_leaves_documents_out():
    rng = np.random.default_rng(1)
    held = [np.array(sorted(rng.choice(40, 12, replace=False)), "<i4") for _ in range(4_000)]
    weights = np.array([10_000] * 3 + [50] * 37)
    ids, ones = np.arange(4_000), [np.ones(12, "<i4").tobytes()] * 4_000
    length, whole = np.full(4_000, 100), np.array([weights[h].sum() * (10 ** 9 // 3000) for h in held])
    best = m.Best(20)
    scored = m.search_group([np.arange(40)], weights, [best], ids, np.zeros(4_000, bool), length, [h.tobytes() for h in held], ones)
    order = np.lexsort((ids, -whole))[:20]
    assert best.ids.tolist() == order.tolist() and scored < 1_000
    assert m.search_group([np.arange(40)], weights // 1_000, [best], ids, np.zeros(4_000, bool), length, [h.tobytes() for h in held], ones) == 0


def test_awkward_tables(spark, awkward, no_documents):
    clashing = awkward.selectExpr("*", "1 as id", "'x' as terms", "2 as rank", "3 as score", "4 as item", "5 as n")
    items = [(1, "quick brown fox"), (1, "short"), (None, "word1 word2"), (2, None), (3, ""), (4, "日本語 cödé"), (4, "日本語 cödé")]
    asked = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id bigint, text string, id string")
    docs = [(r.doc_id, r.text) for r in awkward.collect()]
    assert got(m.search(clashing, asked)) == brute(docs, items)
    assert m.search(no_documents, asked).count() == 0 and m.search(awkward, asked.limit(0)).count() == 0
