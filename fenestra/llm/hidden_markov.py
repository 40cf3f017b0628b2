"""Language-model scoring with a hidden Markov model over the words of the whole corpus.

A text is a sequence of words and one end token. Latent states follow each other by a transition matrix, a state emits a word
class, and the class emits the word. Frequent words are classes of their own, the others share classes by a hash; inside a
class a word has its smoothed share of the class's counts, which are exact counts over all training texts, and one further share
goes to words never seen. So the table of emissions has a fixed size while the vocabulary grows with the corpus.

1. Word counts: tasks count, one row per task and word is shuffled. The counts are written.
2. Encoding: one pass writes every text as class numbers of two bytes. Counts of the most frequent words (``KNOWN`` words and
   ``KNOWN_BYTES`` bytes at most) are broadcast; the remaining words of a text are written beside it.
3. Training: the model starts from the counts of the corpus, a little different in every state. Each of ``ROUNDS`` rounds of
   Baum-Welch goes over all training texts: tasks run forward-backward and add up expected counts, one row per task and class
   is shuffled, and the driver holds the table of classes and states.
4. Scoring: the scaled forward recursion gives the exact likelihood of every class sequence. The remaining words meet their
   counts in a join by word, and are summed per text; as inside a class the state does not matter, that sum is simply added.

Forward-backward works on many texts at once, longest first, in blocks of time: only the states at the start of a block are
kept, so a text of any length needs bounded memory. Expected counts are rounded to 2**-20 before they are added, so the
order of addition does not matter.

Defined results: a null text is scored like an empty one, by its end token; a null id is held out; rows of equal id are texts of
their own; without training texts every token has the same share of nothing, and the base score is 0; an empty
table gives no rows. ASCII letters are lower-cased. Other columns are left out.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fenestra.llm.common import ship, slices
from fenestra.session import stage

ship(__name__)

STATES, ROUNDS = 8, 4
#: Words with a class of their own at most, and hashed classes of the others; with the end token fewer than 65,536.
OWN, HASHED = 16_383, 16_384
#: Words, and bytes of words, whose counts are broadcast at most.
KNOWN, KNOWN_BYTES = 1 << 18, 16 << 20
#: Strength of the corpus-wide distribution in a state's emissions, relative to what the state emits, and of even steps in counts.
PRIOR, PRIOR_STEPS = 0.2, 1.0
ADDED = 0.1
#: Words that a task counts before it sends them on; texts that are read, and tokens that forward-backward works on, at once.
FLUSH = 400_000
GROUP_TOKENS, GROUP_TEXTS, BLOCK_TOKENS = 1 << 19, 16_384, 1 << 19
#: Bytes of text that are numbered at once, about.
TEXT_BYTES = 1 << 20
END = b""
_LEVELS = 8  # steps of a count's logarithm, per doubling
_FIXED = 1 << 20

_TABLE = bytes(32 if i == 32 or 9 <= i <= 13 else i + 32 if 65 <= i <= 90 else i for i in range(256))


def words(text: bytes | None) -> list[bytes]:
    """Lower-cased words of a UTF-8 text."""
    return (text or b"").translate(_TABLE).split()


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10 == 0


def _level(count: Column) -> Column:
    return F.floor(F.log2(count) * _LEVELS).cast("int")


def count_words(docs: DataFrame) -> DataFrame:
    """word, c: occurrences over all texts of (text); the end token is the empty word."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def sent() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())],
                                              names=["word", "n"])
            counts.clear()
            return rows

        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                counts.update(words(text))
                counts[END] += 1
                if len(counts) > FLUSH:
                    yield sent()
        yield sent()

    return docs.select("text").mapInArrow(task, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("c"))


@dataclass
class Classes:
    """Counts of the corpus that have a fixed size: totals, frequent words, and the sums of every class."""

    tokens: int  # N
    distinct: int  # V
    known: list[bytes]
    counts: np.ndarray  # of the known words
    kind: np.ndarray  # their classes
    own: int
    sums: np.ndarray  # tokens by class
    members: np.ndarray  # distinct words by class
    cut: int  # level from which words are known

    @property
    def size(self) -> int:
        return len(self.sums)

    def hashed(self, word: bytes) -> int:
        return 1 + self.own + zlib.crc32(word) % (self.size - 1 - self.own)

    def shared(self) -> np.ndarray:
        """log10 of what the count of a word, and ``ADDED``, is divided by inside its class; 0 marks a class of one word."""
        whole = self.sums + ADDED * (self.members + 1)
        return np.where(np.arange(self.size) <= self.own, 0.0, np.log10(whole))

    def even(self) -> np.ndarray:
        """The corpus-wide distribution over classes."""
        mass = self.sums + ADDED * np.where(np.arange(self.size) <= self.own, 1, self.members + 1)
        return mass / mass.sum()

    def base_scale(self) -> float:
        return math.log10(self.tokens + ADDED * (self.distinct + 1))


def _cut(levels: list, most: int, most_bytes: int) -> int:
    """Least level down to which all words fit."""
    n = size = 0
    cut = 1 << 20
    for r in levels:
        n, size = n + r["n"], size + r["bytes"]
        if n > most or size > most_bytes:
            break
        cut = r["level"]
    return cut


def classes_of(counts: DataFrame, own: int = OWN, hashed: int = HASHED, known: int = KNOWN, known_bytes: int = KNOWN_BYTES) -> Classes:
    levels = counts.groupBy(_level(F.col("c")).alias("level")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("word")).alias("bytes"), F.sum("c").alias("c")).orderBy(F.desc("level")).collect()
    cut, own_cut = _cut(levels, known, known_bytes), _cut(levels, own, known_bytes)
    cut = min(cut, own_cut)
    frequent = counts.where((_level(F.col("c")) >= cut) & (F.length("word") > 0)).select("word", "c").orderBy("word").toArrow()
    names, c = frequent.column("word").to_pylist(), frequent.column("c").to_numpy().astype(np.int64)
    apart = np.array([math.floor(math.log2(x) * _LEVELS) >= own_cut for x in c.tolist()], bool)
    n_own = int(apart.sum())
    out = Classes(sum(r["c"] for r in levels), sum(r["n"] for r in levels), names, c, np.zeros(len(c), np.int64), n_own,
                  np.zeros(1 + n_own + hashed), np.zeros(1 + n_own + hashed), cut)
    out.kind[:] = [0 if alone else out.hashed(w) for alone, w in zip(apart.tolist(), names)]
    out.kind[apart] = np.arange(1, n_own + 1)
    np.add.at(out.sums, out.kind, c)
    np.add.at(out.members, out.kind, 1)
    end = counts.where(F.length("word") == 0).collect()
    out.sums[0], out.members[0] = (end[0]["c"] if end else 0), 1
    rest = counts.where((_level(F.col("c")) < cut) & (F.length("word") > 0))
    for r in rest.groupBy((F.crc32("word") % hashed).alias("k")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).collect():
        out.sums[1 + n_own + r["k"]] += r["c"]
        out.members[1 + n_own + r["k"]] += r["n"]
    return out


@dataclass
class Model:
    start: np.ndarray  # (states,)
    steps: np.ndarray  # (states, states)
    emit: np.ndarray  # (classes, states): share of the class among what a state emits


def first_model(even: np.ndarray, states: int, seed: int = 11) -> Model:
    """Sticky states whose emissions differ a little from the corpus-wide distribution."""
    emit = even[:, None] * np.exp(np.random.default_rng(seed).normal(0, 0.5, (len(even), states)))
    steps = np.full((states, states), 0.05 / max(1, states - 1))
    np.fill_diagonal(steps, 0.95 if states > 1 else 1.0)
    return Model(np.full(states, 1 / states), steps, emit / emit.sum(axis=0))


def grouped(sequences: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(positions, lengths, padded classes) of groups of sequences, longest first, of bounded size."""
    lengths = np.array([len(s) for s in sequences])
    order = np.argsort(-lengths, kind="stable")
    at = 0
    while at < len(order):
        longest = lengths[order[at]]
        own = order[at:at + max(1, GROUP_TOKENS // max(1, longest))]
        padded = np.zeros((longest, len(own)), np.uint16)
        for i, s in enumerate(own.tolist()):
            padded[:lengths[s], i] = sequences[s]
        yield own, lengths[own], padded
        at += len(own)


def _forward(model: Model, padded: np.ndarray, active: np.ndarray, first: int, last: int, state: np.ndarray | None,
             loglik: np.ndarray | None = None, kept: np.ndarray | None = None, scales: np.ndarray | None = None) -> np.ndarray:
    """States after time ``last - 1``, from those before ``first``; every step is scaled to 1.

    The logarithms of the scales are added to ``loglik``; ``kept`` and ``scales`` take all states and scales.
    """
    for t in range(first, last):
        n = active[t]
        ahead = np.empty((n, len(model.start)), model.start.dtype) if kept is None else kept[t - first, :n]
        if t == 0:
            ahead[:] = model.start
        else:
            np.matmul(state[:n], model.steps, out=ahead)
        ahead *= model.emit[padded[t, :n]]
        total = ahead.sum(axis=1)
        ahead /= total[:, None]
        if loglik is not None:
            loglik[:n] += np.log(total)
        if scales is not None:
            scales[t - first, :n] = total
        state = ahead
    return state


def likelihoods(model: Model, sequences: list[np.ndarray]) -> np.ndarray:
    """Natural logarithm of the likelihood of each sequence of classes, exact up to rounding."""
    out = np.zeros(len(sequences))
    for own, lengths, padded in grouped(sequences):
        active = np.searchsorted(-lengths, -np.arange(len(padded)), side="left")
        loglik = np.zeros(len(own))
        if len(padded):
            _forward(model, padded, active, 0, len(padded), None, loglik)
        out[own] = loglik
    return out


class Expected:
    """Expected counts of starts, steps and emissions."""

    def __init__(self, classes: int, states: int):
        self.start, self.steps, self.emit = np.zeros(states), np.zeros((states, states)), np.zeros((classes, states))

    def add(self, model: Model, sequences: list[np.ndarray]) -> None:
        """Forward-backward over sequences: states at the starts of time blocks are kept, blocks are worked off from the last.

        States are scaled at every step, so single precision is enough for counts; sums are in double precision.
        """
        states, kind = len(model.start), np.float32
        model = Model(*(x.astype(kind) for x in (model.start, model.steps, model.emit)))
        for _, lengths, padded in grouped(sequences):
            longest, width = padded.shape
            time = max(1, BLOCK_TOKENS // width)  # one block, unless a single text is longer
            active = np.searchsorted(-lengths, -np.arange(longest + 1), side="left")
            entry, state = [], None
            for first in range(0, longest, time):
                entry.append(state)
                if first + time < longest:
                    state = _forward(model, padded, active, first, first + time, state)
            back = np.ones((width, states), kind)
            ahead = np.zeros((width, states), kind)  # emissions and messages of the step after, scaled
            for k in range(len(entry) - 1, -1, -1):
                first, last = k * time, min(longest, (k + 1) * time)
                n = active[first]
                alpha, scales = np.zeros((last - first, n, states), kind), np.ones((last - first, n), kind)
                _forward(model, padded, active, first, last, entry[k], None, alpha, scales)
                met = np.zeros((states, states))
                for t in range(last - 1, first - 1, -1):
                    now, later = active[t], active[t + 1]
                    own = alpha[t - first, :now]
                    back[later:now] = 1.0
                    if later:
                        np.matmul(ahead[:later], model.steps.T, out=back[:later])
                        met += own[:later].T @ ahead[:later]
                    own *= back[:now]  # from here on the share of each state
                    np.multiply(model.emit[padded[t, :now]], back[:now], out=ahead[:now])
                    ahead[:now] /= scales[t - first, :now, None]
                self.steps += model.steps * met
                if first == 0:
                    self.start += alpha[0].sum(axis=0, dtype=np.float64)
                live = np.arange(n)[None, :] < active[first:last, None]
                shown = padded[first:last, :n][live]
                for s in range(states):
                    self.emit[:, s] += np.bincount(shown, alpha[:, :, s][live], minlength=len(self.emit))


def fitted(expected: Expected, even: np.ndarray) -> Model:
    """The model of largest posterior under the expected counts."""
    start = expected.start + PRIOR_STEPS
    steps = expected.steps + PRIOR_STEPS
    emit = expected.emit + (PRIOR * expected.emit.sum(axis=0) + 1) * even[:, None]
    return Model(start / start.sum(), steps / steps.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def _round(training: DataFrame, model, size: int, states: int) -> Expected:
    """One round of Baum-Welch: expected counts of all sequences under the broadcast model."""
    names = [f"s{i}" for i in range(states)]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Expected(size, states)
        for batch in slices(batches, GROUP_TEXTS):
            total.add(model.value, [np.frombuffer(x, "<u2") for x in batch.column(0).to_pylist()])
        rows = np.rint(np.vstack([total.emit, total.start[None, :], total.steps]) * _FIXED).astype(np.int64)
        used = np.flatnonzero(rows.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *[pa.array(rows[used, i], pa.int64()) for i in range(states)]],
                                         names=["row", *names])

    parts = training.select("ids").mapInArrow(task, "row int, " + ", ".join(f"{n} bigint" for n in names))
    added = parts.groupBy("row").agg(*[F.sum(F.col(n).cast("decimal(20,0)")).cast("double").alias(n) for n in names])
    out = Expected(size, states)
    table = np.zeros((size + 1 + states, states))
    found = added.toArrow()  # as many rows as there are classes and states
    table[found.column("row").to_numpy()] = np.stack([found.column(n).to_numpy() for n in names], axis=1) / _FIXED
    out.emit, out.start, out.steps = table[:size], table[size], table[size + 1:]
    return out


def train(encoded: DataFrame, classes: Classes, states: int = STATES, rounds: int = ROUNDS) -> Model:
    """Baum-Welch over all texts of ``encoded`` that are not held out, from the first round on."""
    spark: SparkSession = encoded.sparkSession
    even, training = classes.even(), encoded.where(~F.col("held_out"))
    model = first_model(even, states)
    for _ in range(rounds):
        model = fitted(_round(training, spark.sparkContext.broadcast(model), classes.size, states), even)
    return model


class _Known(dict):
    """Numbers of words; -1 for others."""

    def __missing__(self, word: bytes) -> int:
        return -1


def _pieces(texts: list[bytes | None]) -> Iterator[list[list[bytes]]]:
    """The words of some texts at a time."""
    held, size = [], 0
    for text in texts:
        held.append(words(text))
        size += len(text or b"")
        if size >= TEXT_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def _numbered(c: Classes, index: _Known, logs: np.ndarray, shared: np.ndarray, texts: list[list[bytes]]) -> tuple[list[np.ndarray], list[bytes], list[bytes]]:
    """Of some texts: tokens, known ones, unknown ones, sums of logarithms of counts and inside classes; class numbers; unknown words."""
    sizes = np.array([len(t) for t in texts], np.int64)
    own = [w for t in texts for w in t]
    at = np.fromiter(map(index.__getitem__, own), np.int64, len(own))
    known = at >= 0
    new = [own[i] for i in np.flatnonzero(~known).tolist()]
    kind = np.empty(len(own), "<u2")
    kind[known] = c.kind[at[known]]
    kind[~known] = 1 + c.own + np.fromiter(map(zlib.crc32, new), np.int64, len(new)) % (c.size - 1 - c.own)
    log = np.zeros(len(own))
    log[known] = logs[at[known]]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    total = lambda values: np.diff(np.concatenate([[0], np.cumsum(values)])[ends])
    # a sum for each text by itself, so that it does not depend on the texts beside it
    added = lambda values: np.array([values[a:b].sum() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())])
    inside = np.where(known & (kind > c.own), log, 0.0) - shared[kind]
    end = np.zeros(1, "<u2").tobytes()
    ids = [kind[a:b].tobytes() + end for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
    seen = total(known.astype(np.int64))
    return [sizes + 1, seen, sizes - seen, added(log), added(inside)], ids, new


_ENCODED = "key bigint, held_out boolean, n_tokens bigint, n_known bigint, base double, inside double, ids binary, rest array<binary>"


def encode(docs: DataFrame, classes) -> DataFrame:
    """(key, id, held_out, text) as class numbers, with the logarithms that known words give and the words that are not known."""
    id_type = docs.schema["id"].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Classes = classes.value
        if not hasattr(c, "index"):  # kept with the broadcast value for the next task of the process
            c.index = _Known({w: i for i, w in enumerate(c.known)})
        logs, shared = np.log10(c.counts + ADDED), c.shared()
        end_log, end_known = math.log10(c.sums[0] + ADDED), int(c.sums[0] > 0)
        for batch in slices(batches):
            at = 0
            for texts in _pieces(batch.column(3).to_pylist()):
                (n, seen, unseen, log, inside), ids, new = _numbered(c, c.index, logs, shared, texts)
                left = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(unseen)]), pa.int32()), pa.array(new, pa.binary()))
                columns = [pa.array(n, pa.int64()), pa.array(seen + end_known, pa.int64()), pa.array(log + end_log, pa.float64()),
                           pa.array(inside, pa.float64()), pa.array(ids, pa.binary()), left]
                yield pa.RecordBatch.from_arrays([*batch.slice(at, len(texts)).columns[:3], *columns],
                                                 names=["key", "id", "held_out", "n_tokens", "n_known", "base", "inside", "ids", "rest"])
                at += len(texts)

    return docs.select("key", "id", "held_out", "text").mapInArrow(task, _ENCODED.replace("held_out", f"id {id_type}, held_out", 1))


def _rest(encoded: DataFrame, counts: DataFrame, cut: int) -> DataFrame:
    """key, log, seen: what the words that are not known add to each text, by a join with their counts."""
    asked = encoded.select("key", F.explode("rest").alias("word"))
    held = counts.where((_level(F.col("c")) < cut) & (F.length("word") > 0))
    met = asked.join(held, "word", "left")
    return met.groupBy("key").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + ADDED)).alias("log"), F.count("c").alias("seen"))


def _likelihoods(encoded: DataFrame, model) -> DataFrame:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, GROUP_TEXTS):
            if batch.num_rows:
                logs = likelihoods(model.value, [np.frombuffer(x, "<u2") for x in batch.column(7).to_pylist()])
                yield pa.RecordBatch.from_arrays([*batch.columns[:7], pa.array(logs / math.log(10), pa.float64())],
                                                 names=[*names, "classes"])

    names = ["key", "id", "held_out", "n_tokens", "n_known", "base", "inside"]
    schema = ", ".join(f"{n} {encoded.schema[n].dataType.simpleString()}" for n in names) + ", classes double"
    return encoded.select(*names, "ids").mapInArrow(task, schema)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    key = F.col(f"`{id_col}`")
    source = docs.select(key.alias("id"), held_out(key).alias("held_out"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    counts = stage(count_words(source.where(~F.col("held_out"))), "words")
    classes = classes_of(counts)
    sent = docs.sparkSession.sparkContext.broadcast(classes)
    encoded = stage(encode(source.withColumn("key", F.monotonically_increasing_id()), sent), "encoded")
    model = docs.sparkSession.sparkContext.broadcast(train(encoded, classes, states, rounds))
    found = _likelihoods(encoded, model).join(_rest(encoded, counts, classes.cut), "key", "left")
    more = F.coalesce("log", F.lit(0.0))
    return found.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("seen", F.lit(0))).alias("n_known"),
        F.lit(classes.tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * classes.base_scale()).alias("base_score"),
        (F.col("inside") + more + F.col("classes")).alias("score"))
