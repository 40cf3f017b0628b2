import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from fenestra.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
TOKENS = bpe.read_ranks(PATH)
SHIFTS, IDS = bpe.perfect_hash(TOKENS)
VOCABULARY = {"tokens": TOKENS, "shifts": SHIFTS, "ids": IDS, "pattern": PATTERN}
REFERENCE = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={t: i for i, t in enumerate(TOKENS)}, special_tokens={})


def ids(text):
    return np.frombuffer(next(bpe.Encoder(VOCABULARY).ids([text])), "<u4").tolist()


def test_hash_is_minimal_and_perfect():
    assert sorted(IDS.tolist()) == list(range(len(TOKENS)))
    assert (bpe.resolve(TOKENS, VOCABULARY) == np.arange(len(TOKENS))).all()
    assert bpe.resolve([b"", b"no such token at all"], VOCABULARY).tolist() == [-1, -1]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_equals_the_library(text):
    text = text.encode("utf-8", "ignore").decode()
    assert ids(text) == REFERENCE.encode_ordinary(text)


@pytest.mark.parametrize("text", ["a" * 20_000, "ab" * 9_999, " " * 5_000, "<|endoftext|>", "日本" * 3_000, "x\n\n \ty'll"])
def test_long_and_odd_texts(text):
    assert ids(text) == REFERENCE.encode_ordinary(text)


@pytest.mark.parametrize("size", [1, 700, 2_000])
def test_memory_has_two_generations(monkeypatch, size):
    monkeypatch.setattr(bpe, "REMEMBERED", size)
    monkeypatch.setattr(bpe, "SPLIT_AT_ONCE", 20)
    vocabulary = dict(VOCABULARY)
    for k in ("ranks", "young", "old", "used"):
        vocabulary.pop(k, None)
    texts = ["several different words that do not fit", "words that do", None, "unfitting differentlyish wordings", "x" * 5_000] * 4
    encoder = bpe.Encoder(vocabulary)
    for text, found in zip(texts, encoder.ids(texts)):
        assert np.frombuffer(found, "<u4").tolist() == REFERENCE.encode_ordinary(text or "")
        assert encoder.text(found) == (text or "").encode()
    assert len(vocabulary["young"]) + len(vocabulary["old"]) < 30


def test_tables(awkward, no_documents):
    rows = bpe.digests(awkward, ["doc_id"], PATH, PATTERN).collect()
    texts = [r.text or "" for r in awkward.select("text").collect()]
    for r, text in zip(rows, texts):
        want = REFERENCE.encode_ordinary(text)
        assert r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.digests(no_documents, ["doc_id"], PATH, PATTERN).count() == 0


def test_round_trip_through_columns(awkward):
    encoded = bpe.encode(awkward, ["doc_id", "text"], PATH, PATTERN)
    back = bpe.decode(encoded, ["text"], PATH, PATTERN).collect()
    assert [r.bytes.decode() for r in back] == [r.text or "" for r in back]


def test_query_covers_all_documents(spark, sf):
    from fenestra.llm.queries import all_queries

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = all_queries()["op5_byte_bpe"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
        want = np.array(REFERENCE.encode_ordinary(texts[r.doc_id]), "<u4").tobytes()
        assert r.ids_sha256 == hashlib.sha256(want).hexdigest()
