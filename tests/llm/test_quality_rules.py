import re
from collections import Counter

from hypothesis import given, settings, strategies as st

from fenestra.llm import quality_rules as q


def brute_repeated(words):
    windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    return len({i + k for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for k in range(8)})


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("ab"), max_size=60))
def test_repeated_windows(words):
    assert q.repeated_words(words) == brute_repeated(words)


def test_measures_of_one_text():
    text = "one two\none two\n\n \n#*$ A!\r\x0bB"
    n, chars, symbols, dups, repeats, lines, upper, shouts = q.measure(text)
    assert n == len(re.findall(r"[^\x20\x09-\x0D]+", text)) == 7
    assert (chars, symbols, dups, repeats, lines, upper, shouts) == (18, 3, 1, 0, 3, 2, 1)
    assert q.measure(None) == q.measure("") == (0,) * 8


def test_awkward_rows(spark, awkward, no_documents):
    found = q.verdicts(q.ledger(awkward, awkward.columns))
    assert len(set(found.columns)) == len(found.columns)
    rows = found.collect()
    assert len(rows) == awkward.count()
    by = {r.doc_id: r for r in rows}
    assert by[1].kept and not by[1].base_failed and by[1].n_words == 22
    assert all(by[k].base_failed and not by[k].kept for k in (4, 5, 7, 8))
    assert by[6].n_words == 60_000 and by[6].n_repeat_words == 60_000 and by[6].base_failed
    assert q.ledger(no_documents, ["doc_id"]).count() == 0


def test_stage_keeps_columns(awkward, no_documents):
    kept = q.good_documents(awkward)
    assert kept.schema == awkward.schema
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3]
    assert q.good_documents(no_documents).count() == 0


def test_symbols_capitals_and_exclamations_go(spark):
    plain = "some plain words in a row that say nothing at all but are quite enough to be read as a text"
    rows = [(1, plain), (2, " ".join(w + "###" for w in plain.split())), (3, plain.upper()),
            (4, " ".join(w + "!" for w in plain.split()))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = q.verdicts(q.ledger(docs, ["doc_id"])).collect()
    assert {r.doc_id: (r.kept, r.base_failed) for r in found} == {1: (True, False), 2: (False, False), 3: (False, False), 4: (False, False)}


def test_ablations_agree_with_single_policies(spark, sf):
    from fenestra.llm.common import table

    found = q.ledger(table(spark, sf, "documents"), ["doc_id"]).cache()
    kept = found.where(q.DEFAULT.keeps()).count()
    for r in q.ablations(found).collect():
        without = q.Policy("t", q.DEFAULT.veto & ~r.bit, q.DEFAULT.advisory & ~r.bit, q.DEFAULT.allowed)
        assert r.kept == kept and r.kept_without == found.where(without.keeps()).count()
        assert r.only_rejected_by == r.kept_without - kept
        assert r.failing == found.where(f"fail_bits & {r.bit} != 0").count()
    found.unpersist()
