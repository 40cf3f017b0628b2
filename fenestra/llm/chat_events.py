"""Chat formatting from an event log: fold the events of a conversation, then render it.

A log row is one event: conversation, sequence number, message id, kind, role, text.

* ``delta`` opens its message at the end if it is new, and appends its text;
* ``edit`` replaces the text of its message (and opens it if it is new);
* ``regenerate`` drops its message and all that were opened after it; deltas then build it again;
* ``delete`` drops its message.

Events of a conversation are partitioned together, sorted by sequence number and folded as a
stream, so a task holds one conversation at a time. Events of equal sequence number are taken in
the order of message, kind, role and text; an event that was delivered twice (all fields
equal) counts once. Unknown kinds and a null kind are an error, since skipping them would lose text.

The template marks turns with ``<|im_start|>`` and ``<|im_end|>``. Control strings inside texts are
escaped by one more backslash between ``<`` and ``|``, which can be undone exactly.

Defined results: null roles and texts are empty; a null conversation id is a conversation of
its own; a conversation without messages is rendered as an empty string; an empty log gives no rows; columns
of the log besides the six named are left out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import StructField, StructType

from fenestra.llm.common import ship

ship(__name__)

START, END = "<|im_start|>", "<|im_end|>"
LEARNED_ROLE = "assistant"
EVENT = ["conv_id", "seq", "msg", "kind", "role", "text"]

_CONTROL, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.S)


def escape(text: str) -> str:
    """No ``<|`` is left; ``unescape`` gives the text back."""
    return _CONTROL.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def _role_out(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _role_in(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


class Conversation:
    """The state of one conversation while its events arrive."""

    def __init__(self) -> None:
        self.messages: dict[object, tuple[str, list[str]]] = {}
        self.seen: tuple | None = None

    def apply(self, seq: object, msg: object, kind: str, role: str | None, text: str | None) -> None:
        event = (seq, msg, kind, role, text)
        if event == self.seen:
            return
        self.seen = event
        if kind == "delta":
            self.messages.setdefault(msg, (role or "", []))[1].append(text or "")
        elif kind == "edit":
            held = self.messages.setdefault(msg, (role or "", []))[1]
            held[:] = [text or ""]
        elif kind == "regenerate":
            opened = list(self.messages)
            for later in opened[opened.index(msg):] if msg in self.messages else ():
                del self.messages[later]
        elif kind == "delete":
            self.messages.pop(msg, None)
        else:
            raise ValueError(f"unknown event kind {kind!r}")

    def turns(self) -> list[tuple[str, str]]:
        return [(role, "".join(parts)) for role, parts in self.messages.values()]


def render(turns: list[tuple[str, str]]) -> tuple[str, list[dict[str, int]]]:
    """The formatted text and the spans, in code points, of the texts to be learned."""
    out, at, mask = [], 0, []
    for role, text in turns:
        head, body, foot = f"{START}{_role_out(role)}\n", escape(text), f"{END}\n"
        if role == LEARNED_ROLE:
            mask.append({"start": at + len(head), "end": at + len(head) + len(body)})
        out += [head, body, foot]
        at += len(head) + len(body) + len(foot)
    return "".join(out), mask


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text; anything that is not a turn is an error."""
    turns, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            break
        turns.append((_role_in(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError("not a sequence of turns")
    return turns


def fold(events: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans of each conversation of an event log.

    The window brings a conversation's events together, unless they already are, and puts them in order.
    """
    order = Window.partitionBy("conv_id").orderBy("seq", "msg", "kind", "role", "text")
    events = events.select(*EVENT).withColumn("place", F.row_number().over(order))
    spans = "array<struct<start:bigint,end:bigint>>"
    fields = StructType.fromDDL(f"formatted string, loss_spans {spans}").fields
    schema = StructType([StructField("conv_id", events.schema["conv_id"].dataType), *fields])
    pair = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = object()
        conv, state, kind = none, Conversation(), None

        def out(done: list) -> pa.RecordBatch:
            ids, rendered = [c for c, _ in done], [render(s.turns()) for _, s in done]
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, kind), pa.array([r[0] for r in rendered], pa.string()),
                 pa.array([r[1] for r in rendered], pa.list_(pair))], names=["conv_id", "formatted", "loss_spans"])

        for batch in batches:
            kind, done = batch.schema.field(0).type, []
            for c, *event in zip(*[column.to_pylist() for column in batch.columns[:len(EVENT)]]):
                if c != conv:
                    if conv is not none:
                        done.append((conv, state))
                    conv, state = c, Conversation()
                state.apply(*event)
            yield out(done)
        if conv is not none:
            yield out([(conv, state)])

    return events.mapInArrow(task, schema)


def events_of_turns(turns: DataFrame) -> DataFrame:
    """Rows of turns (conv_id, turn, role, text) as the log of a chat service that ends in these turns.

    Every turn is streamed in two deltas. By its number, a turn's first delta was wrong and is edited, or a first answer
    (with a further message after it) was abandoned and is regenerated, or the second delta is delivered
    twice, or a message is sent in between and deleted again. Turns of equal number follow each other by role and
    text; equal rows stay two turns. Events of a turn come in reverse order.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = turns.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text")).withColumn(
        "msg", F.row_number().over(order).cast("bigint"))
    text, half = F.col("text"), F.floor(F.length("text") / 2).cast("int")
    left, right = F.substring(text, F.lit(1), half), F.substring(text, half + 1, F.length(text))
    event = lambda k, kind, text, msg=F.col("msg"): F.struct(
        (F.col("msg") * 8 + k).alias("seq"), msg.alias("msg"), F.lit(kind).alias("kind"), "role", text.alias("text"))
    late, aside = -F.col("msg") * 2, -F.col("msg") * 2 - 1  # ids of messages that do not last
    plain = [event(5, "delta", left), event(6, "delta", right)]
    stories = [
        [event(1, "delta", F.lit("<|draft|> ")), event(2, "edit", left), event(6, "delta", right)],
        [event(1, "delta", F.lit("abandoned")), event(2, "delta", right, late), event(3, "regenerate", F.lit("")), *plain],
        [*plain, event(6, "delta", right)],
        [event(1, "delta", F.lit("aside"), aside), event(2, "delete", F.lit(""), aside), *plain],
    ]
    kind = F.pmod(F.xxhash64("conv_id", "msg"), F.lit(len(stories)))
    log = F.array(*plain)
    for k, story in enumerate(stories):
        log = F.when(kind == k, F.reverse(F.array(*story))).otherwise(log)
    return numbered.select("conv_id", F.inline(log))


def read_back(formatted: DataFrame) -> DataFrame:
    """Turn counts and digests of formatted conversations, from their text and mask alone."""
    schema = StructType([formatted.schema["conv_id"], *StructType.fromDDL(
        "n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint").fields])

    def digest(text: str, mask: list[dict]) -> tuple:
        turns = parse(text)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        learned = "".join(unescape(text[s["start"]:s["end"]]) for s in mask)
        return (len(turns), sha("".join(f"{role}\n{said}\n" for role, said in turns)), len(learned), sha(learned), len(text))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [digest(t, m) for t, m in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            columns = list(zip(*rows)) or [()] * 5
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                                             names=schema.names)

    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(task, schema)
