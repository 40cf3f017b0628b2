import hashlib
from collections import defaultdict

import pytest
from hypothesis import given, settings, strategies as st

from fenestra.llm import chat_events as c

EVENTS = "conv_id bigint, seq bigint, msg bigint, kind string, role string, text string"
texts = st.text(alphabet="<|>\\im_endstar\n é", max_size=40)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a\nb", "<|x\\n", ""]), texts), max_size=5))
def test_template_can_be_read_back(turns):
    formatted, mask = c.render(turns)
    assert c.parse(formatted) == turns
    assert [c.unescape(formatted[s["start"]:s["end"]]) for s in mask] == [t for r, t in turns if r == "assistant"]
    assert all("<|" not in c.escape(t) and c.unescape(c.escape(t)) == t for _, t in turns)


def folded(spark, rows):
    found = c.fold(spark.createDataFrame(rows, EVENTS)).collect()
    return {r.conv_id: c.parse(r.formatted) for r in found}


def test_deltas_edits_and_regenerations(spark):
    rows = [
        (1, 9, 3, "delta", None, "lo"), (1, 1, 1, "delta", "user", "hi"), (1, 2, 2, "delta", "assistant", "dra"),
        (1, 3, 2, "delta", None, "ft"), (1, 4, 1, "edit", None, "hello"), (1, 5, 2, "regenerate", None, None),
        (1, 6, 2, "delta", "assistant", "final"), (1, 8, 3, "delta", "user", "hal"), (1, 8, 3, "delta", "user", "hal"),
        (1, 10, 4, "delta", "user", "gone"), (1, 11, 4, "delete", None, None),
        (2, 1, 7, "edit", "user", "opened by an edit"), (2, 2, 8, "regenerate", None, None),
        (None, 1, 1, "delta", None, None), (3, 1, 1, "delta", "user", "x"), (3, 2, 1, "delete", None, None),
    ]
    got = folded(spark, rows)
    assert got[1] == [("user", "hello"), ("assistant", "final"), ("user", "hallo")]
    assert got[2] == [("user", "opened by an edit")]
    assert got[None] == [("", "")] and got[3] == []


def test_order_of_equal_numbers_is_defined(spark):
    rows = [(1, 1, m, "delta", "user", t) for m, t in ((2, "b"), (1, "a"), (1, "A"))]
    assert folded(spark, rows)[1] == folded(spark, rows[::-1])[1] == [("user", "Aa"), ("user", "b")]


def test_empty_log_and_unknown_kind(spark):
    assert folded(spark, []) == {}
    with pytest.raises(Exception, match="unknown event kind"):
        folded(spark, [(1, 1, 1, "other", "user", "x")])


def check(rows, turns):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    by = defaultdict(list)
    for conv, turn, role, text in turns:
        by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    assert {r.conv_id for r in rows} == set(by)
    for r in rows:
        said = [(role, text) for _, _, role, text in sorted(by[r.conv_id])]
        learned = "".join(t for role, t in said if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(said), sha("".join(f"{a}\n{t}\n" for a, t in said)))
        assert (r.loss_chars, r.loss_sha256) == (len(learned), sha(learned))


def test_query(spark, sf):
    from fenestra.llm.queries import all_queries

    rows = all_queries()["op3_chat_events"](spark, sf).collect()
    turns = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    said = "<|im_end|><|im_start|>assistant ok"
    check(rows, [*turns, (-1, 0, "user", said), (-1, 1, "assistant", said)])


def test_awkward_turns(spark):
    turns = [(1, 1, "user", "a"), (1, 1, "user", "a"), (1, 2, "assistant", None), (1, None, None, "first"), (2, 0, "assistant", "é" * 200_000),
             (None, 3, "user", "x"), (2, 1, "user", "")]
    table = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")
    rows = c.read_back(c.fold(c.events_of_turns(table))).collect()
    check(rows, turns)


def test_the_log_of_turns_has_every_kind_of_event(spark, sf):
    turns = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text")
    log = c.events_of_turns(turns)
    rows = log.collect()
    assert {r.kind for r in rows} == {"delta", "edit", "regenerate", "delete"}
    assert len(set(rows)) < len(rows) and [r.seq for r in rows] != sorted(r.seq for r in rows)
    check(c.read_back(c.fold(log.repartition(7))).collect(), [tuple(r) for r in turns.collect()])
