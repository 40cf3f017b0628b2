"""Ranked lexical search by presence masks.

A document's score for an item is the sum of what the item's terms contribute there. Most documents hold only some of the
terms, and those that hold the same ones have the same upper bound: the sum of the largest contributions of these terms.

1. Items are dealt in blocks of a bounded number of terms; one block's terms are broadcast at a time.
2. One pass over the texts counts, and writes, the occurrences of the block's terms per document. The numbers of documents,
   of terms and of documents per term are added up from that table.
3. A task takes its documents in groups. For each item, the bitmap of present terms is packed into one mask per document,
   documents of equal mask form a group, and the masks are worked off by descending upper bound until the next one
   is below the k-th score that the task has found so far: the rest is safely left out.
4. Each task gives its k best documents per item; they are reduced to k in two steps, so no item is one task's.

Terms are runs of ASCII letters, digits and all other characters beyond ASCII; only A-Z are lower-cased. Scores are exact integers.

Defined results: null texts have no terms and count nowhere, like texts without terms; every row is a document, so repeated rows
are ranked one after the other; a null id is ranked after equal scores. Items of one id are one item with the
terms of all its rows, a null item id is an item as well; an item without terms, or whose terms occur nowhere, has no
rows. Empty tables give no rows. Other columns are left out.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from fenestra.llm.common import ship, slices
from fenestra.session import stage

ship(__name__)

TOP = 50
#: About as many (item, term) pairs, and bytes of them, are broadcast at once; an item is never split.
BLOCK_TERMS, BLOCK_BYTES = 50_000, 4 << 20
#: Documents that a task groups by mask at once, and postings of them.
GROUP_DOCS, GROUP_POSTINGS = 4_096, 1 << 21
#: Documents scored at least before the bound is looked at again.
_STEP = 128

# Separators and capitals of ASCII; everything else belongs to terms.
_SEPARATORS = [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
_TABLE = bytes(32 if i in set(_SEPARATORS) else i + 32 if 65 <= i <= 90 else i for i in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """Lower-cased terms of a UTF-8 text, with repeats."""
    return (text or b"").translate(_TABLE).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [sorted(set(terms(t))) for t in batch.column(1).to_pylist()]
            at = np.repeat(np.arange(len(found)), [len(x) for x in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array([t for x in found for t in x], pa.binary())], names=["item", "term"])

    kind = items.schema[id_col].dataType.simpleString()
    return items.select(F.col(f"`{id_col}`").alias("item"), F.col(f"`{text_col}`").cast("binary").alias("text")).mapInArrow(
        task, f"item {kind}, term binary").distinct()


def _counted(docs: DataFrame, known) -> DataFrame:
    """id, n, terms, times: of every document with terms, how often it holds the block's terms (little-endian integers)."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = {t: i for i, t in enumerate(known.value)}
        for batch in slices(batches):
            n, held, times = [], [], []
            for text in batch.column(1).to_pylist():
                own = terms(text)
                pairs = [(index[t], c) for t, c in Counter(own).items() if t in index]
                n.append(len(own))
                held.append(np.array([p[0] for p in pairs], "<i4").tobytes())
                times.append(np.array([p[1] for p in pairs], "<i4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(held, pa.binary()), pa.array(times, pa.binary())],
                                             names=["id", "n", "terms", "times"])

    return docs.mapInArrow(task, f"id {docs.schema['id'].dataType.simpleString()}, n bigint, terms binary, times binary").where("n > 0")


def _frequencies(counted: DataFrame, size: int) -> list[int]:
    """Documents holding each term of the block: one row per task and term is shuffled."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for batch in batches:
            df += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i4"), minlength=size)
        used = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(df[used], pa.int64())], names=["term", "df"])

    found = counted.select("terms").mapInArrow(task, "term int, df bigint").groupBy("term").agg(F.sum("df").alias("df"))
    out = [0] * size
    for r in found.collect():  # as many rows as the block has terms
        out[r["term"]] = r["df"]
    return out


def masks_of(present: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first row of each mask, mask number of each row, rows per mask) of a boolean matrix, by its packed bits."""
    packed = np.packbits(present, axis=1)
    wide = np.zeros((len(packed), -(-packed.shape[1] // 8) * 8), np.uint8)
    wide[:, :packed.shape[1]] = packed
    words = wide.view(np.uint64)
    keys = words[:, 0] if words.shape[1] == 1 else np.ascontiguousarray(words).view(f"V{8 * words.shape[1]}").ravel()
    _, first, group, count = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    return first, group.ravel(), count


class Best:
    """The k best (score, id) of one item; a null id comes last among equal scores."""

    def __init__(self, k: int):
        self.k = k
        self.scores, self.ids, self.null = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    @property
    def least(self) -> int:
        """Scores below this one cannot enter."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def offer(self, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        enter = scores >= self.least
        if enter.any():
            scores, ids, null = (np.concatenate([a, b[enter]]) for a, b in zip((self.scores, self.ids, self.null), (scores, ids, null)))
            order = np.lexsort((ids, null, -scores))[:self.k]
            self.scores, self.ids, self.null = scores[order], ids[order], null[order]


def search_group(items: list[np.ndarray], weights: np.ndarray, best: list[Best], ids: np.ndarray, null: np.ndarray,
                 m: np.ndarray, held: list[bytes], times: list[bytes]) -> int:
    """Offer a group of documents to the items' best lists; returns how many documents were scored."""
    sizes = np.array([len(h) // 4 for h in held])
    doc = np.repeat(np.arange(len(held)), sizes)
    term, tf = np.frombuffer(b"".join(held), "<i4"), np.frombuffer(b"".join(times), "<i4").astype(np.int64)
    order = np.argsort(term, kind="stable")
    doc, term, tf = doc[order], term[order], tf[order]
    gain = np.concatenate([[0], weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[doc]))])
    ends = np.searchsorted(term, np.arange(len(weights) + 1))
    most = np.zeros(len(weights), np.int64)
    filled = np.flatnonzero(np.diff(ends))
    most[filled] = np.maximum.reduceat(gain[1:], ends[filled]) if len(filled) else 0
    scored = 0
    for own, top in zip(items, best):
        own = own[ends[own + 1] > ends[own]]
        if not len(own) or most[own].sum() < top.least:
            continue
        at = np.zeros((len(held), len(own)), np.int32)  # number of the posting, 0 where the term is absent
        for k, t in enumerate(own.tolist()):
            at[doc[ends[t]:ends[t + 1]], k] = np.arange(ends[t] + 1, ends[t + 1] + 1)
        present = at > 0
        first, group, count = masks_of(present)
        bound = present[first] @ most[own]
        ranked = np.argsort(-bound, kind="stable")
        place = np.empty(len(ranked), np.int64)
        place[ranked] = np.arange(len(ranked))
        docs, upto = np.argsort(place[group], kind="stable"), np.cumsum(count[ranked])
        mask = done = 0
        while mask < len(ranked) and bound[ranked[mask]] >= top.least:
            stop = int(np.searchsorted(upto, done + _STEP)) + 1  # whole masks only
            stop = min(stop, int(np.searchsorted(-bound[ranked], -top.least, side="right")))
            chosen = docs[done:upto[stop - 1]]
            top.offer(gain[at[chosen]].sum(axis=1), ids[chosen], null[chosen])
            mask, done, scored = stop, int(upto[stop - 1]), scored + len(chosen)
    return scored


def _ranked_by_task(counted: DataFrame, block, n_docs: int, n_terms: int, k: int, item_type: str) -> DataFrame:
    id_type = counted.schema["id"].dataType.simpleString()

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(iter([batch]), GROUP_DOCS):
                sizes = np.cumsum([len(x) // 4 for x in part.column(2).to_pylist()]) // GROUP_POSTINGS
                cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), part.num_rows]
                for start, end in zip(cuts, cuts[1:]):
                    if end > start:
                        yield part.slice(start, end - start)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared: dict[str, Any] = block.value
        best = [Best(k) for _ in shared["items"]]
        for part in groups(batches):
            m = np.array([100 - 50 + (50 * n * n_docs) // n_terms for n in part.column(1).to_pylist()], np.int64)
            null = np.asarray(part.column(0).is_null())
            ids = part.column(0).fill_null(0).cast(pa.int64()).to_numpy(zero_copy_only=False)
            search_group(shared["items"], shared["weights"], best, ids, null, m, part.column(2).to_pylist(), part.column(3).to_pylist())
        for item, top in zip(shared["ids"], best):
            if len(top.ids):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([item] * len(top.ids), pa.int64()), pa.array(top.ids, pa.int64(), mask=top.null), pa.array(top.scores, pa.int64())],
                    names=["item", "id", "score"])

    found = counted.mapInArrow(task, "item bigint, id bigint, score bigint")
    return found.select(F.col("item").cast(item_type).alias("item"), F.col("id").cast(id_type).alias("id"), "score")


def _first(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = [F.desc("score"), F.col("id").asc_nulls_last()]
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item id, rank, id, score: the k best documents of every item, integer ids on both sides."""
    spark = docs.sparkSession
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    item_type = items.schema[item_col].dataType.simpleString()
    asked = stage(_item_terms(items, item_col, item_text_col), "items")
    size = asked.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("term")), F.lit(0)).alias("b")).first()
    blocks = max(1, -(-size["n"] // BLOCK_TERMS), -(-size["b"] // BLOCK_BYTES))
    placed = asked.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)))
    found = None
    for b in range(blocks):
        wanted: dict[Any, list[bytes]] = {}
        for r in placed.where(F.col("block") == b).collect():  # one block, of bounded size
            wanted.setdefault(r["item"], []).append(bytes(r["term"]))
        vocabulary = sorted({t for own in wanted.values() for t in own})
        index = {t: i for i, t in enumerate(vocabulary)}
        counted = stage(_counted(source, spark.sparkContext.broadcast(vocabulary)), "counted")
        total = counted.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
        weights = [weight(total["docs"], df) for df in _frequencies(counted, len(vocabulary))]
        sent = spark.sparkContext.broadcast({
            "ids": list(wanted), "items": [np.array(sorted(index[t] for t in own), np.int64) for own in wanted.values()],
            "weights": np.array(weights, np.int64)})
        best = _ranked_by_task(counted, sent, total["docs"], max(1, total["terms"]), k, item_type)
        found = best if found is None else found.unionByName(best)
    dealt = found.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(64)))
    return _first(_first(dealt, ["item", "part"], k).drop("rank"), ["item"], k).select(
        F.col("item").alias(item_col), F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
