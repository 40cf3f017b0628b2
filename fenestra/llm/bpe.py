"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary resolves whole pre-tokens; a slot holds
one token, so one comparison of bytes settles a lookup. Tier two: other pre-tokens are merged
over a doubly linked list of byte spans with a heap of candidate merges, O(n log n) even for
a pre-token of a whole long text.

Defined results: a null text encodes like an empty one, to no ids; repeated rows repeat; an
empty table gives no rows; kept columns pass through, and one named like a result column is
replaced. Ids outside the vocabulary are an error when decoding; null ids decode to nothing.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import struct
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from fenestra.llm.common import ship, slices, with_fields

ship(__name__)

#: Size in bytes, about, of the pre-tokens that one generation of a worker's memory holds, and of what an entry takes besides.
REMEMBERED = 48 << 20
_OVERHEAD = 200
#: Characters that are split into pre-tokens at once.
SPLIT_AT_ONCE = 1 << 20
_MIX = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by rank from a rank file; ranks must be dense."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    tokens = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in tokens] != list(range(len(tokens))):
        raise ValueError("ranks are not dense")
    return tokens


def _slots(hashes: np.ndarray, shift: np.ndarray, n: int) -> np.ndarray:
    """Slot of a hash under its bucket's displacement."""
    x = (hashes + shift.astype(np.uint64) * np.uint64(_MIX)) & np.uint64(_MASK)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(32))) % np.uint64(n)).astype(np.int64)


def perfect_hash(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(displacement by bucket, token id by slot): every token gets a slot of its own."""
    n = len(tokens)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, tokens), np.uint64, n)
    buckets = max(1, n // 4)
    home = (hashes % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(home, kind="stable")
    starts = np.searchsorted(home[order], np.arange(buckets + 1))
    shifts, ids = np.zeros(buckets, np.uint32), np.full(n, -1, np.int32)
    for b in np.argsort(-np.diff(starts), kind="stable"):
        members = order[starts[b]:starts[b + 1]]
        if not len(members):
            break
        first = 0
        while True:  # many displacements at once; the last buckets need long searches
            tries = np.arange(first, first + 256, dtype=np.uint32)
            found = _slots(hashes[members][None, :], tries[:, None], n)
            free = (ids[found] < 0).all(axis=1)
            if len(members) > 1:
                free &= (np.diff(np.sort(found, axis=1), axis=1) > 0).all(axis=1)
            if free.any():
                k = int(np.argmax(free))
                shifts[b] = tries[k]
                ids[found[k]] = members
                break
            first += 256
    return shifts, ids


def resolve(tokens: list[bytes], vocabulary: dict[str, Any]) -> np.ndarray:
    """Ids of whole pre-tokens by the perfect hash, -1 for those not in the vocabulary."""
    known, shifts, ids = vocabulary["tokens"], vocabulary["shifts"], vocabulary["ids"]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, tokens), np.uint64, len(tokens))
    at = ids[_slots(hashes, shifts[(hashes % np.uint64(len(shifts))).astype(np.int64)], len(ids))]
    return np.fromiter((i if known[i] == t else -1 for i, t in zip(at.tolist(), tokens)), np.int64, len(tokens))


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: always the lowest rank first, the leftmost of equals.

    A candidate is one number made of rank, start and end, and counts if two neighbouring spans still cover just these bytes.
    """
    n = len(piece)
    after = list(range(1, n + 1))  # start of the next span; n at the end, 0 inside a span
    before = list(range(-1, n))
    bits = n.bit_length()
    low = (1 << bits) - 1
    rank_of = ranks.get
    heap = [rank << 2 * bits | i << bits | i + 2 for i in range(n - 1) if (rank := rank_of(piece[i:i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        candidate = heapq.heappop(heap)
        left, end = candidate >> bits & low, candidate & low
        right = after[left]
        if not 0 < right < end or after[right] != end:  # one of the spans has changed
            continue
        after[left] = end
        after[right] = 0
        if end < n:
            before[end] = left
            stop = after[end]
            rank = rank_of(piece[left:stop])
            if rank is not None:
                heapq.heappush(heap, rank << 2 * bits | left << bits | stop)
        start = before[left]
        if start >= 0:
            rank = rank_of(piece[start:end])
            if rank is not None:
                heapq.heappush(heap, rank << 2 * bits | start << bits | end)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i:after[i]]])
        i = after[i]
    return out


def broadcast_vocabulary(spark: SparkSession, path: str, pattern: str):
    """The vocabulary with its perfect hash, sent to every executor once; its size is that of the file."""
    tokens = read_ranks(path)
    shifts, ids = perfect_hash(tokens)
    return spark.sparkContext.broadcast({"tokens": tokens, "shifts": shifts, "ids": ids, "pattern": pattern})


class Encoder:
    """Encodes the texts of a task; keeps its memory with the broadcast value for the next task.

    The memory holds the ids of pre-tokens in two generations of bounded size: those used since the last change, and the
    ones before, from which they come back when they are used again.
    """

    def __init__(self, vocabulary: dict[str, Any]):
        self.vocabulary, self.tokens = vocabulary, vocabulary["tokens"]
        self.split = regex.compile(vocabulary["pattern"]).findall
        if "ranks" not in vocabulary:
            vocabulary |= {"ranks": {t: i for i, t in enumerate(self.tokens)}, "young": {}, "old": {}, "used": 0}
        self.ranks = vocabulary["ranks"]

    def learn(self, pieces: set[str]) -> dict[str, bytes]:
        """The memory, with the ids of all pieces as little-endian bytes: one look-up in the hash for all that are new."""
        v = self.vocabulary
        young, old = v["young"], v["old"]
        missing = pieces - young.keys()
        new = []
        for piece in missing:
            known = old.get(piece)
            if known is None:
                new.append(piece)
            else:
                young[piece] = known
        raw = [p.encode() for p in new]
        whole = resolve(raw, v).tolist() if raw else ()
        for piece, data, at in zip(new, raw, whole):
            if at >= 0:
                young[piece] = at.to_bytes(4, "little")
            else:
                ids = merge(data, self.ranks)
                young[piece] = struct.pack(f"<{len(ids)}I", *ids)
        v["used"] += sum(map(len, missing)) + _OVERHEAD * len(missing)
        return young

    def forget(self) -> None:
        """Start a new generation when the young one is full."""
        v = self.vocabulary
        if v["used"] > REMEMBERED:
            v["old"] = v["young"] if v["used"] < 2 * REMEMBERED else {}
            v["young"], v["used"] = {}, 0

    def ids(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; texts are split some at a time."""
        at = 0
        while at < len(texts):
            held, size = [], 0
            while at < len(texts) and (not held or size < SPLIT_AT_ONCE):
                held.append(self.split(texts[at] or ""))
                size += len(texts[at] or "")
                at += 1
            memory = self.learn(set().union(*held))
            for pieces in held:
                yield b"".join(map(memory.__getitem__, pieces))
            self.forget()

    def text(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, struct.unpack(f"<{len(ids) // 4}I", ids)))


def encode(docs: DataFrame, keep: list[str], path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """Add ``ids``, an array of token ids, to the kept columns."""
    shared = broadcast_vocabulary(docs.sparkSession, path, pattern)
    schema = with_fields(docs, keep, "ids array<bigint>")
    carried = [c for c in schema.names if c != "ids"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in slices(batches):
            ids = [np.frombuffer(x, "<u4").astype(np.int64)
                   for x in encoder.ids(batch.column(len(carried)).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(carried)], pa.array(ids, pa.list_(pa.int64()))], names=[*carried, "ids"])

    columns = [F.col(f"`{c}`") for c in carried]
    return docs.select(*columns, F.col(f"`{text_col}`").alias("_text")).mapInArrow(task, schema)


def decode(encoded: DataFrame, keep: list[str], path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """Add ``bytes``, the decoded bytes of an id array, to the kept columns."""
    shared = broadcast_vocabulary(encoded.sparkSession, path, pattern)
    schema = with_fields(encoded, keep, "bytes binary")
    carried = [c for c in schema.names if c != "bytes"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = shared.value["tokens"]
        for batch in slices(batches):
            texts = [b"".join(map(tokens.__getitem__, ids or ())) for ids in batch.column(len(carried)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(carried)], pa.array(texts, pa.binary())], names=[*carried, "bytes"])

    columns = [F.col(f"`{c}`") for c in carried]
    return encoded.select(*columns, F.col(f"`{ids_col}`").alias("_ids")).mapInArrow(task, schema)


_DIGESTS = ["n_tokens", "ids_sha256", "decoded_sha256"]


def digests(docs: DataFrame, keep: list[str], path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """Encode, decode the ids again, and return the number of tokens and both digests.

    The same work as ``encode`` and ``decode`` in one pass, without sending ids
    through the JVM in between.
    """
    shared = broadcast_vocabulary(docs.sparkSession, path, pattern)
    schema = with_fields(docs, keep, "n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    carried = [c for c in schema.names if c not in _DIGESTS]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, sha = Encoder(shared.value), lambda x: hashlib.sha256(x).hexdigest()
        for batch in slices(batches):
            rows = [(len(x) // 4, sha(x), sha(encoder.text(x)))
                    for x in encoder.ids(batch.column(len(carried)).to_pylist())]
            n, ids, decoded = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(carried)], pa.array(n, pa.int64()), pa.array(ids, pa.string()),
                 pa.array(decoded, pa.string())], names=[*carried, *_DIGESTS])

    columns = [F.col(f"`{c}`") for c in carried]
    return docs.select(*columns, F.col(f"`{text_col}`").alias("_text")).mapInArrow(task, schema)
