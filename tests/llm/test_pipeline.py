"""The corpus pipeline against a plain version of every stage, and the registration without it."""

import hashlib
import os
import shutil
import subprocess
import sys
from collections import Counter, defaultdict

import numpy as np

sys.path[:0] = [os.path.dirname(os.path.abspath(__file__)), os.path.join(os.path.dirname(os.path.abspath(__file__)), "..", "..")]

import corpus_pipeline  # noqa: E402
from test_bpe import REFERENCE  # noqa: E402
from test_poisson_mix import draw  # noqa: E402
from test_randomness import base_spans  # noqa: E402

from fenestra.llm import quality_rules as q, superminhash  # noqa: E402


def is_good(text):
    n, chars, symbols, dups, repeats, lines, upper, shouts = q.measure(text)
    if n < 20 or 100 * repeats > 30 * n or 10 * symbols > 3 * n or 5 * upper > 2 * chars or 2 * shouts > n:
        return False
    return (chars < 2 * n or chars > 15 * n) + (2 * dups > lines) <= 1


def masked(text):
    out, at = "", 0
    spans = [tuple(map(int, s.split(":")[1:])) for s in base_spans(text).split(",") if s]
    for start, end in spans:
        if start >= at:
            out += text[at:start] + "[SECRET]"
        at = max(at, end)
    return out + text[at:] if spans else text


def roots_at(docs, percent):
    """Least id of every component of (id, text), by comparing all pairs that share a five-word shingle."""
    sets, holders = {}, defaultdict(set)
    for d, text in docs:
        words = text.lower().split()
        sets[d] = {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
        for g in sets[d]:
            holders[g].add(d)
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for d, own in sets.items():
        for e in set().union(*(holders[g] for g in own)):
            if e < d and 100 * len(own & sets[e]) >= percent * len(own | sets[e]):
                a, b = find(d), find(e)
                root[max(a, b)] = min(a, b)
    return {d: find(d) for d in sets}


def test_every_stage_by_brute_force(spark, sf):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    good = {d: r for d, r in docs.items() if is_good(r.text)}
    roots = roots_at([(d, r.text) for d, r in good.items()], 80)
    single = {d: r for d, r in good.items() if roots[d] == d}
    assert 0 < len(single) < len(good) < len(docs)
    clean = {d: (r.source, masked(r.text)) for d, r in single.items()}
    volume = defaultdict(int)
    for source, text in clean.values():
        volume[source] += len(text)
    weight = {s: v ** 0.5 for s, v in volume.items()}
    rate = {s: round(weight[s] / sum(weight.values()) * sum(volume.values()) / volume[s], 9) for s in volume}
    want = Counter()
    for d, (source, text) in clean.items():
        ids = REFERENCE.encode_ordinary(text)
        sha = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        want[d, source, len(ids), sha, hashlib.sha256(text.encode()).hexdigest()] += draw(rate[source], d)
    got = Counter((r.doc_id, r.source, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, sf).collect())
    assert got == +want


def test_stages_keep_the_columns_of_documents(spark, sf, awkward, no_documents):
    for docs in (spark.read.parquet(f"{sf}/documents.parquet"), awkward.select("doc_id", "text", "lang", "source", "n_chars"),
                 no_documents.select("doc_id", "text", "lang", "source", "n_chars")):
        for _, step in corpus_pipeline.STAGES[:-1]:
            assert [(f.name, f.dataType) for f in step(spark, docs, sf).schema] == [(f.name, f.dataType) for f in docs.schema]
    assert len(corpus_pipeline.STAGES) == 5
    docs = no_documents
    for _, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, sf)
    assert docs.count() == 0


def test_columns_of_any_name_pass_through(spark, sf, awkward, clashing):
    extra = [c for c in clashing.columns if c not in awkward.columns]
    plain = ["doc_id", "text", "lang", "source", "n_chars"]
    for _, step in corpus_pipeline.STAGES[:-1]:
        rows = step(spark, clashing, sf)
        assert rows.columns == clashing.columns
        assert sorted(map(str, rows.select(plain).collect())) == sorted(map(str, step(spark, awkward.select(plain), sf).collect()))
        for r in rows.collect():
            assert [r[c] for c in extra] == list(range(len(extra)))
    tokens = corpus_pipeline.STAGES[-1][1](spark, clashing, sf)
    assert tokens.count() == clashing.count()


def test_the_rest_works_without_these_operators(tmp_path):
    root = os.path.join(os.path.dirname(os.path.abspath(__file__)), "..", "..")
    shutil.copytree(root, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') and n[2].isdigit() for n in e.queries()), len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", capture_output=True, text=True, timeout=60)
    assert done.returncode == 0, done.stderr
    assert done.stdout.split()[1] == "False" and int(done.stdout.split()[0]) > 70


def single_at(docs, percent):
    return {d for d, root in roots_at(docs, percent).items() if d == root}


def test_near_dedup_stage_links_at_80_per_cent(spark, sf, monkeypatch):
    monkeypatch.setattr(superminhash, "BLOCK", 8)
    docs = []
    for n in [*range(45, 70), *range(90, 130)]:  # one inner word changed, or two far apart: around 0.80 and 0.85
        words = [f"t{n}_{i}" for i in range(n)]
        docs.append(words)
        docs.append([f"c{i}" if i in ((n // 2,) if n < 70 else (n // 4, 3 * n // 4)) else w for i, w in enumerate(words)])
    for n in (50, 60):  # many texts that are near the first only, by another place each
        docs += [[f"v{i}_{k}" if i == 5 + k else f"s{n}_{i}" for i in range(n)] for k in range(40)]
    docs = [(k, " ".join(words)) for k, words in enumerate(docs)]
    want = single_at(docs, 80)
    assert want < single_at(docs, 85) and len(want) < len(docs)
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, frame, sf).collect()} == want
    assert {r.doc_id for r in superminhash.near_duplicates(frame).where("kept").collect()} == single_at(docs, 85)
