"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and one
failure bit per rule; policies are versioned sets of masks over those bits, so a new
policy or an ablation never reads a text again.

Defined results: a null or empty text has no words and fails ``few_words``; repeated rows
give repeated ledger rows; an empty table gives an empty ledger; a column of the input that
has the name of a ledger column is replaced by it. Texts are measured whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from fenestra.llm.common import ship, slices, with_fields
from fenestra.session import stage

ship(__name__)

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = re.compile("[A-ZÀ-ÖØ-Þ]")
SYMBOLS = "#*$%&|<>"
WINDOW = 8

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_exclaim"]
LEDGER = ", ".join(f"{c} bigint" for c in MEASURES)

#: Bit -> (name, failure condition over the measurements). Bits are never reused.
RULES: list[tuple[str, Callable[[], Column]]] = [
    ("few_words", lambda: F.col("n_words") < 20),
    ("repeated_windows", lambda: 100 * F.col("n_repeat_words") > 30 * F.col("n_words")),
    ("symbols", lambda: 10 * F.col("n_symbols") > 3 * F.col("n_words")),
    ("capitals", lambda: 5 * F.col("n_upper") > 2 * F.col("word_chars")),
    ("exclamations", lambda: 2 * F.col("n_exclaim") > F.col("n_words")),
    ("word_length", lambda: (F.col("word_chars") < 2 * F.col("n_words"))
     | (F.col("word_chars") > 15 * F.col("n_words"))),
    ("repeated_lines", lambda: 2 * F.col("n_dup_lines") > F.col("n_lines")),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """Documents go if a veto bit failed, or more than ``allowed`` of the advisory ones."""

    version: str
    veto: int
    advisory: int = 0
    allowed: int = 0

    def keeps(self, bits: str | Column = "fail_bits") -> Column:
        bits = F.col(bits) if isinstance(bits, str) else bits
        return (bits.bitwiseAND(F.lit(self.veto)) == 0) & (
            F.bit_count(bits.bitwiseAND(F.lit(self.advisory))) <= self.allowed)


BASE = Policy("base", BIT["few_words"] | BIT["repeated_windows"])
DEFAULT = Policy("2", BASE.veto | BIT["symbols"] | BIT["capitals"] | BIT["exclamations"],
                 BIT["word_length"] | BIT["repeated_lines"], 1)
STRICT = Policy("3", DEFAULT.veto | DEFAULT.advisory)


def repeated_words(words: list[str], size: int = WINDOW) -> int:
    """Words inside windows of ``size`` (a power of two) words that occur twice or more.

    Windows get exact dense numbers by doubling: numbers of two neighbouring halves
    make the number of the whole, so no hash can collide.
    """
    if len(words) <= size:
        return 0
    numbers: dict[str, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    span, n, counts = 1, len(numbers), None
    while span < size:
        found, ids, counts = np.unique(ids[:-span] * n + ids[span:], return_inverse=True, return_counts=True)
        if counts.max() == 1:
            return 0
        n, span = len(found), 2 * span
    starts = counts[ids] > 1
    marks = np.zeros(len(words) + 1, np.int64)
    marks[:len(starts)] += starts
    marks[size:size + len(starts)] -= starts
    return int(np.count_nonzero(np.cumsum(marks[:-1])))


def measure(text: str | None) -> tuple[int, ...]:
    """The measurements of one text, in the order of ``MEASURES``."""
    text = text or ""
    words = WORD.findall(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return (len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)),
            repeated_words(words), len(lines), len(UPPER.findall(text)), text.count("!"))


def ledger(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The kept columns, the measurements and ``fail_bits`` for every row; one narrow pass."""
    schema = with_fields(docs, keep, LEDGER)
    carried = [c for c in schema.names if c not in MEASURES]
    # a text that is kept anyway is sent once
    at = carried.index(text_col) if text_col in carried else len(carried)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [measure(t) for t in batch.column(at).to_pylist()]
            found = np.array(rows, np.int64).reshape(len(rows), len(MEASURES))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(carried)], *[pa.array(found[:, i]) for i in range(len(MEASURES))]],
                names=[*carried, *MEASURES])

    extra = [] if at < len(carried) else [F.col(f"`{text_col}`").alias("_measured_text")]
    measured = docs.select(*[F.col(f"`{c}`") for c in carried], *extra).mapInArrow(task, schema)
    bits = None
    for name, failed in RULES:
        bit = F.when(failed(), F.lit(BIT[name])).otherwise(F.lit(0)).cast("bigint")
        bits = bit if bits is None else bits.bitwiseOR(bit)
    return measured.withColumn("fail_bits", bits)


def verdicts(found: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """Add ``base_failed``, ``kept`` and ``policy`` to a ledger; they replace columns of these names."""
    columns = [F.col(f"`{c}`") for c in found.columns if c not in ("base_failed", "kept", "policy")]
    return found.select(*columns, (~BASE.keeps()).alias("base_failed"), (BASE.keeps() & policy.keeps()).alias("kept"),
                        F.lit(policy.version).alias("policy"))


def deciding_rules(policy: Policy = DEFAULT) -> Column:
    """Rules without any one of which a rejected row would be kept, by name; from the failure bits alone."""
    without = lambda bit: F.col("fail_bits").bitwiseAND(F.lit(~bit))
    names = [F.when(~policy.keeps() & policy.keeps(without(b)), n) for n, b in BIT.items() if b & (policy.veto | policy.advisory)]
    return F.array_join(F.array_compact(F.array(*names)), ",")


def with_patterns(found: DataFrame) -> DataFrame:
    """Add ``same_bits``: rows of the ledger with the same failure bits. The ledger is written, its texts are read once."""
    kept = stage(found.drop("same_bits"), "ledger")
    patterns = stage(kept.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("same_bits")), "patterns")  # at most two to the number of rules
    return kept.join(patterns, "fail_bits")


def ablations(found: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """Per rule of the policy: rows it fails, rows only it rejects, rows kept without it.

    One aggregation over the distinct bit patterns, of which there are at most
    two to the number of rules.
    """
    patterns = found.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("rows"))
    used = [(n, b) for n, b in BIT.items() if b & (policy.veto | policy.advisory)]
    rules = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(b).cast("bigint").alias("bit")) for n, b in used]))
    rows = patterns.select("fail_bits", "rows", rules.alias("r")).select("fail_bits", "rows", "r.rule", "r.bit")
    without = F.col("fail_bits").bitwiseAND(F.bitwise_not("bit"))
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("rows"))), F.lit(0))
    return rows.groupBy("rule", "bit").agg(
        count(F.col("fail_bits").bitwiseAND(F.col("bit")) != 0).alias("failing"),
        count(~policy.keeps() & policy.keeps(without)).alias("only_rejected_by"),
        count(policy.keeps(without)).alias("kept_without"),
        count(policy.keeps()).alias("kept"))


def good_documents(docs: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """The rows of ``docs`` that the policy keeps, with the columns of ``docs``."""
    names = {f"_c{i}": c for i, c in enumerate(docs.columns)}  # free of the names of the ledger
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for n, c in names.items()])
    text = next(n for n, c in names.items() if c == "text")
    kept = ledger(rows, list(names), text).where(BASE.keeps() & policy.keeps())
    return kept.select(*[F.col(n).alias(c) for n, c in names.items()])
