import math
import re
import string
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fenestra.llm import hidden_markov as h

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def tokens(text):
    return [w.encode() for w in WORD.findall((text or "").translate(LOWER))] + [b""]


def is_held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0


def base(docs):
    """{position: (held, n, known, N, score)} by plain counting."""
    counts = Counter(t for i, text in docs if not is_held(i) for t in tokens(text))
    n, v = sum(counts.values()), len(counts)
    return [(i, is_held(i), len(own := tokens(text)), sum(counts[t] > 0 for t in own), n,
             sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in own)) for i, text in docs]


def small_model(classes=20, states=3, seed=1):
    rng = np.random.default_rng(seed)
    draw = lambda *shape: rng.random(shape) + 0.05
    start, steps, emit = draw(states), draw(states, states), draw(classes, states)
    return h.Model(start / start.sum(), steps / steps.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def plain_forward_backward(model, sequence):
    """(log-likelihood, start, steps, emissions) of one sequence with exact fractions of unscaled products."""
    s = len(model.start)
    alpha = [model.start * model.emit[sequence[0]]]
    for x in sequence[1:]:
        alpha.append((alpha[-1] @ model.steps) * model.emit[x])
    beta = [np.ones(s)]
    for x in sequence[:0:-1]:
        beta.insert(0, model.steps @ (model.emit[x] * beta[0]))
    total = alpha[-1].sum()
    gamma = [a * b / total for a, b in zip(alpha, beta)]
    steps, emit = np.zeros((s, s)), np.zeros_like(model.emit)
    for t in range(len(sequence) - 1):
        steps += np.outer(alpha[t], model.emit[sequence[t + 1]] * beta[t + 1]) * model.steps / total
    for t, x in enumerate(sequence):
        emit[x] += gamma[t]
    return math.log(total), gamma[0], steps, emit


SEQUENCES = [np.random.default_rng(k).integers(0, 20, n).astype(np.uint16) for k, n in enumerate([1, 2, 40, 7, 7, 90, 1, 33, 128, 64])]


@pytest.mark.parametrize("block, group", [(1, 1 << 19), (100, 1 << 19), (64, 150), (1 << 19, 1)])
def test_forward_backward_equals_the_plain_one(monkeypatch, block, group):
    monkeypatch.setattr(h, "BLOCK_TOKENS", block)
    monkeypatch.setattr(h, "GROUP_TOKENS", group)
    model = small_model()
    want = [plain_forward_backward(model, s) for s in SEQUENCES]
    assert np.allclose(h.likelihoods(model, SEQUENCES), [w[0] for w in want])
    found = h.Expected(20, 3)
    found.add(model, SEQUENCES)
    for got, k in ((found.start, 1), (found.steps, 2), (found.emit, 3)):
        assert np.allclose(got, sum(w[k] for w in want))


def test_long_sequences_do_not_underflow():
    model, long = small_model(), np.random.default_rng(9).integers(0, 20, 30_000).astype(np.uint16)
    both = h.likelihoods(model, [long, long[:10]])
    assert -200_000 < both[0] < -20_000 and np.isfinite(both).all()
    found = h.Expected(20, 3)
    found.add(model, [long])
    assert np.isclose(found.emit.sum(), 30_000) and np.isclose(found.steps.sum(), 29_999)


def test_baum_welch_raises_the_likelihood():
    model, true = small_model(seed=2), small_model(seed=7)
    rng = np.random.default_rng(3)
    texts = []
    for _ in range(60):
        state, out = rng.choice(3, p=true.start), []
        for _ in range(50):
            out.append(rng.choice(20, p=true.emit[:, state]))
            state = rng.choice(3, p=true.steps[state])
        texts.append(np.array(out, np.uint16))
    seen = [h.likelihoods(model, texts).sum()]
    for _ in range(6):
        found = h.Expected(20, 3)
        found.add(model, texts)
        model = h.Model(found.start / found.start.sum(), found.steps / found.steps.sum(axis=1, keepdims=True), found.emit / found.emit.sum(axis=0))
        seen.append(h.likelihoods(model, texts).sum())
    assert all(b >= a - 1e-6 for a, b in zip(seen, seen[1:])) and seen[-1] > seen[0] + 50


@pytest.fixture(scope="module")
def documents(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


def test_query_equals_plain_counts_and_beats_them(spark, sf, documents):
    from fenestra.llm.queries import all_queries

    rows = {r.doc_id: r for r in all_queries()["op11_hidden_markov"](spark, sf).collect()}
    want = base(documents)
    assert len(rows) == len(want)
    for i, held, n, known, total, score in want:
        r = rows[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert math.isclose(r.base_score, score, rel_tol=1e-9) and math.isfinite(r.score) and r.score < 0
    for held in (True, False):
        own = [r for r in rows.values() if r.held_out == held]
        assert sum(r.score for r in own) > sum(r.base_score for r in own)


def test_words_beyond_the_broadcast_give_the_same(spark, documents, monkeypatch):
    frame = spark.createDataFrame(documents[:60], "doc_id bigint, text string").repartition(3)
    whole = {r.doc_id: r for r in h.score(frame, rounds=1).collect()}
    original = h.classes_of
    monkeypatch.setattr(h, "classes_of", lambda counts: original(counts, known=h.OWN - 9_000))
    monkeypatch.setattr(h, "OWN", 100)
    few = {r.doc_id: r for r in h.score(frame, rounds=1).collect()}
    for i, r in whole.items():
        assert (r.n_tokens, r.n_known) == (few[i].n_tokens, few[i].n_known)
        assert math.isclose(r.base_score, few[i].base_score, rel_tol=1e-9)


def test_the_model_is_a_distribution(spark, documents):
    """All words of the corpus and one unseen word per class: what a state emits sums to one."""
    frame = spark.createDataFrame(documents[:80], "doc_id bigint, text string")
    texts = frame.select(F.col("text").cast("binary").alias("text"))
    counts = h.count_words(texts).cache()
    c = h.classes_of(counts, own=50, hashed=16, known=400)
    assert len(c.known) <= 400 and c.own <= 50 and c.tokens == sum(r.c for r in counts.collect())
    inside = np.zeros(c.size)
    known = dict(zip(c.known, c.kind.tolist()))
    for r in counts.collect():
        word = bytes(r.word)
        kind = 0 if not word else known.get(word, c.hashed(word))
        inside[kind] += 1.0 if kind <= c.own else (r.c + h.ADDED) / 10 ** c.shared()[kind]
    inside[c.own + 1:] += h.ADDED / 10 ** c.shared()[c.own + 1:]
    assert np.allclose(inside, 1.0) and np.isclose(c.even().sum(), 1.0)
    counts.unpersist()


def test_scores_add_up(spark, documents):
    """The query's score against class likelihood and shares worked out word by word."""
    frame = spark.createDataFrame(documents[:50], "doc_id bigint, text string")
    source = frame.select(F.col("doc_id").alias("id"), h.held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("binary").alias("text"),
                          F.monotonically_increasing_id().alias("key"))
    counts = h.count_words(source.where("not held_out"))
    c = h.classes_of(counts, own=30, hashed=8, known=60)
    plain = {bytes(r.word): r.c for r in counts.collect()}
    known = dict(zip(c.known, c.kind.tolist()))
    sent = spark.sparkContext.broadcast(c)
    encoded = h.encode(source, sent)
    model = h.first_model(c.even(), 4)
    found = h._likelihoods(encoded, spark.sparkContext.broadcast(model)).join(h._rest(encoded, counts, c.cut), "key", "left")
    rows = {r.id: r.inside + (r.log or 0.0) + r.classes for r in found.collect()}
    for i, text in documents[:50]:
        own = tokens(text)
        kinds = [0 if not w else known.get(w, c.hashed(w)) for w in own]
        share = sum(math.log10((plain.get(w, 0) + h.ADDED) / (c.sums[k] + h.ADDED * (c.members[k] + 1))) for w, k in zip(own, kinds) if k > c.own)
        want = share + h.likelihoods(model, [np.array(kinds, np.uint16)])[0] / math.log(10)
        assert math.isclose(rows[i], want, rel_tol=1e-9)


def test_awkward_tables(spark, awkward, no_documents):
    clashing = awkward.selectExpr("*", "1 as id", "'x' as key", "2 as held_out", "3 as score", "4 as word", "5 as ids")
    docs = [(r.doc_id, r.text) for r in awkward.collect()]
    want = sorted(base(docs), key=str)
    rows = sorted(h.score(clashing, rounds=1).collect(), key=lambda r: str((r.doc_id, r.held_out, r.n_tokens)))
    assert [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in rows] == [w[:5] for w in want]
    for r, w in zip(rows, want):
        assert math.isclose(r.base_score, w[5], rel_tol=1e-9) and r.score < 0
    assert h.score(no_documents).count() == 0
    only = h.score(awkward.where("doc_id = 6").selectExpr("*").union(awkward.where("doc_id is null")), rounds=1).collect()
    assert {r.held_out for r in only} >= {True}


def test_nothing_to_learn_from(spark):
    held = next(i for i in range(100) if is_held(i))
    rows = h.score(spark.createDataFrame([(held, "a b a"), (held, None)], "doc_id bigint, text string")).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens) for r in sorted(rows, key=lambda r: -r.n_tokens)] == [(4, 0, 0), (1, 0, 0)]
    assert all(abs(r.base_score) < 1e-9 and math.isfinite(r.score) and r.score < 0 for r in rows)


def test_every_round_of_training_takes_all_texts(spark):
    """No text or token is left out of what the model starts from: one round is one round over the whole corpus."""
    rows = [(i, " ".join(f"w{(i * 7 + j * j) % 97}" for j in range(2_500 if i == 3 else 20))) for i in range(700)]
    docs = spark.createDataFrame([(i, t) for i, t in rows], "key bigint, text string").select(
        "key", F.col("key").alias("id"), F.lit(False).alias("held_out"), F.col("text").cast("binary").alias("text"))
    classes = h.classes_of(h.count_words(docs))
    encoded = h.encode(docs, spark.sparkContext.broadcast(classes)).localCheckpoint()
    first = h.first_model(classes.even(), h.STATES)
    assert np.allclose(h.train(encoded, classes, rounds=0).emit, first.emit, rtol=1e-12)
    expected = h.Expected(classes.size, h.STATES)
    expected.add(first, [np.frombuffer(r["ids"], "<u2") for r in encoded.orderBy("key").collect()])
    whole = h.fitted(expected, classes.even())
    model = h.train(encoded, classes, rounds=1)
    assert np.allclose(model.emit, whole.emit, rtol=1e-3, atol=1e-7) and np.allclose(model.steps, whole.steps, rtol=1e-3)
