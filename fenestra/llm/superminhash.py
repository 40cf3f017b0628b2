"""Near-duplicates by SuperMinHash signatures, banding, verification and union-find.

SuperMinHash draws, for every shingle, correlated ranks over the registers: a random permutation
of the registers, of which the j-th gets a value in [j, j + 1). A register keeps its least value, so
the errors of registers offset each other and the signature varies less than that of independent hashes.
Ranks grow with j: once every register holds a value below j, later ones cannot matter, and the
signature of a set of n shingles is done after about 256 * ln(256) / n steps.

1. Signatures: one narrow pass over the texts; a register is kept as one byte. Equal sets become one class
   (their copies never meet in pairs).
2. Banding: 42 bands of 6 registers. Two sets of similarity 0.85 share no band once in 400 million, two of 0.80
   three times in a million.
3. Links to a centre: in each band's bucket every class is compared with the least one only, so a bucket of n
   classes gives n - 1 pairs. Pairs whose signatures differ too much for the threshold (five
   standard deviations) go; the rest is confirmed on the full shingle sets, read again from the texts.
4. Union-find over confirmed links, then steps 3 and 4 again with other centres.
5. What is left: buckets that still hold several components. Their classes are dealt in blocks, every pair of blocks is one
   task row group, and only pairs of different components with fitting signatures leave it, to be confirmed
   like the others. So all links between components are found, however large a bucket is.

Defined results: a null text or one without words has an empty set, and is linked with nothing; rows of equal
id are one document, to which the links of all its texts count; an empty table gives no rows; other columns are left out. ASCII letters are lower-cased.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from fenestra.llm.common import by_position, name_of, runs, ship, slices, small_batches
from fenestra.session import stage

ship(__name__)

SHINGLE = 5
#: Least similarity of a link, in per cent: that of ``near_duplicates``, and that of ``without_duplicates``.
THRESHOLD, STAGE_THRESHOLD = 85, 80
BANDS, ROWS = 42, 6
REGISTERS = BANDS * ROWS
#: Shingles drawn at once; bounds the memory of a task.
CHUNK = 1 << 15
#: Classes per block where buckets are compared within; bounds the memory of a task.
BLOCK = 512

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
_U = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of a common 64-bit mixing function, element by element."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(text: str | None) -> np.ndarray:
    """Distinct 64-bit hashes of the word shingles of a text, sorted."""
    words = _WORD.findall((text or "").translate(_LOWER))
    if not words:
        return np.empty(0, _U)
    hashed = np.fromiter((xxhash.xxh64_intdigest(w) for w in map(str.encode, words)), _U, len(words))
    width = min(SHINGLE, len(words))
    out = np.full(len(words) - width + 1, _U(width))
    for k in range(width):
        out = _mixed(out * _U(0x9E3779B97F4A7C15) + hashed[k:len(hashed) - width + 1 + k])
    return np.unique(out)


def _registers(elements: np.ndarray, owner: np.ndarray, sets: int) -> np.ndarray:
    """Least value per set and register, for many sets at once: ``elements`` with the number of their set."""
    m = REGISTERS
    best = np.full(sets * m, np.iinfo(np.int64).max, np.int64)
    cells = owner.astype(np.int64) * m
    order = np.tile(np.arange(m, dtype=np.uint8), (len(elements), 1)).ravel()
    row = np.arange(len(elements), dtype=np.int64) * m
    state = elements
    for j in range(m):
        state = _mixed(state + _U(0x9E3779B97F4A7C15))
        k = j + ((state >> _U(40)) * _U(m - j) >> _U(24)).astype(np.int64)
        chosen = order[row + k]
        order[row + k] = order[row + j]
        value = (np.int64(j) << 40) | (state & _U((1 << 40) - 1)).astype(np.int64)
        np.minimum.at(best, cells + chosen, value)
        # a set is done when no register can be improved by the next step
        unfinished = best.reshape(sets, m).max(axis=1) >= (np.int64(j + 1) << 40)
        if not unfinished.any():
            break
        if unfinished.mean() < 0.75:
            keep = np.flatnonzero(unfinished[owner])
            if len(keep) < len(owner):
                order = order.reshape(-1, m)[keep].ravel()
                owner, cells, state = owner[keep], cells[keep], state[keep]
                row = np.arange(len(keep), dtype=np.int64) * m
    return best.reshape(sets, m)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One byte per register, the lowest of its least value; sets are drawn in chunks, large ones in parts."""
    out = np.zeros((len(sets), REGISTERS), np.uint8)
    at = 0
    while at < len(sets):
        upto, total = at, 0
        while upto < len(sets) and (upto == at or total + len(sets[upto]) <= CHUNK):
            total += len(sets[upto])
            upto += 1
        group = sets[at:upto]
        if total > CHUNK:
            parts = [group[0][i:i + CHUNK] for i in range(0, total, CHUNK)]
            best = np.min([_registers(p, np.zeros(len(p), np.int64), 1) for p in parts], axis=0)
        elif total:
            best = _registers(np.concatenate(group), np.repeat(np.arange(len(group)), [len(s) for s in group]), len(group))
        if total:
            out[at:upto] = best & 255
        at = upto
    return out


def similar(a: np.ndarray, b: np.ndarray, threshold: int) -> bool:
    """The exact rule on two sets of distinct shingles."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= threshold * (len(a) + len(b) - shared)


def plausible(sig: np.ndarray, n: int, sigs: np.ndarray, ns: np.ndarray, threshold: int) -> np.ndarray:
    """Which sets may be similar to one set: sizes fit and the signatures agree to five standard deviations."""
    t = threshold / 100
    fits = 100 * np.minimum(n, ns) >= threshold * np.maximum(n, ns)
    return fits & ((sigs == sig).mean(axis=1) >= t - 5 * (t * (1 - t) / REGISTERS) ** 0.5)


def _signed(docs: DataFrame) -> DataFrame:
    """id, n_shingles, set_id (128-bit hash of the set) and sig of every row."""
    schema = f"id {docs.schema['id'].dataType.simpleString()}, n_shingles bigint, set_id binary, sig binary"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingles(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                 pa.array([s.tobytes() for s in signatures(sets)], pa.binary())],
                names=["id", "n_shingles", "set_id", "sig"])

    return docs.mapInArrow(task, schema)


def _with_sets(docs: DataFrame) -> DataFrame:
    """c, n, sig and the shingle set of every row of (id, text)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingles(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([s.tobytes() for s in signatures(sets)], pa.binary()),
                 pa.array([s.tobytes() for s in sets], pa.binary())], names=["c", "n", "sig", "shingles"])

    return docs.mapInArrow(task, "c bigint, n bigint, sig binary, shingles binary").where("n > 0")


def _links(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())],
                                      names=["a", "b"])


def _centre_links(pairs: DataFrame, sets: DataFrame, threshold: int, per_task: int = 2_000) -> DataFrame:
    """Confirmed links among (c, pivot, size); a centre of large buckets is dealt out with their members."""
    salts = F.ceil(F.col("size") / per_task).cast("int")
    salted = pairs.select("pivot", F.pmod(F.xxhash64("c"), salts).cast("int").alias("salt"), "c")
    centres = salted.select("pivot", "salt").distinct()
    columns = ["pivot", "salt", "side", "c", "n", "sig", "shingles"]
    members = salted.join(sets, "c").withColumn("side", F.lit(1)).select(*columns)
    heads = centres.join(sets.withColumnRenamed("c", "pivot"), "pivot").select(
        "pivot", "salt", F.lit(0).alias("side"), F.col("pivot").alias("c"), "n", "sig", "shingles")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, centre = None, []
        for batch in batches:
            found = []
            for pivot, salt, side, c, n, sig, data in zip(*[x.to_pylist() for x in batch.columns]):
                if (pivot, salt) != held:
                    held, centre = (pivot, salt), []
                mine = np.frombuffer(data, _U)
                if side == 0:
                    centre.append((np.frombuffer(sig, np.uint8), n, mine))
                    continue
                own = np.frombuffer(sig, np.uint8)[None, :]
                if any(plausible(s, m, own, np.array([n]), threshold)[0] and similar(theirs, mine, threshold) for s, m, theirs in centre):
                    found.append((c, pivot))
            yield _links(found)

    dealt = heads.unionByName(members).repartition("pivot", "salt").sortWithinPartitions("pivot", "salt", "side")
    return dealt.mapInArrow(task, "a bigint, b bigint")


def _block_pairs(members: DataFrame) -> DataFrame:
    """Deal the members of each bucket in blocks; every pair of blocks becomes one group of rows."""
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = members.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    return own.select("*", other).withColumn("lo", F.least("block", "other")).withColumn(
        "hi", F.greatest("block", "other")).drop("blocks", "other")


def _compared(group: list[tuple], threshold: int) -> Iterator[tuple[int, int]]:
    """Positions of rows (bucket, lo, hi, band, block, comp, c, n, sig, ...) that may be similar.

    Rows of one component are no pair, nor are rows whose first common band is another one.
    """
    _, lo, hi, band = group[0][:4]
    sigs = np.frombuffer(b"".join(r[8] for r in group), np.uint8).reshape(len(group), REGISTERS)
    ns, comps, blocks = (np.array([r[i] for r in group]) for i in (7, 5, 4))
    for i in range(len(group)):
        rest = np.arange(i + 1, len(group))
        rest = rest[(comps[rest] != comps[i]) & ((blocks[rest] != blocks[i]) | (lo == hi))]
        rest = rest[plausible(sigs[i], ns[i], sigs[rest], ns[rest], threshold)] if len(rest) else rest
        if len(rest):
            shared = (sigs[rest] == sigs[i]).reshape(-1, BANDS, ROWS).all(axis=2)
            for j in rest[shared.argmax(axis=1) == band].tolist():
                yield i, j


_GROUP = ["bucket", "lo", "hi", "band"]
_MEMBER = [*_GROUP, "block", "comp", "c", "n", "sig"]


def _suspects(rows: DataFrame, threshold: int) -> DataFrame:
    """The rows of block pairs that have a possible partner there."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in runs(batches, 4):
            used = sorted({x for pair in _compared(group, threshold) for x in pair})
            columns = list(zip(*[group[x][:7] for x in used])) or [()] * 7
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], names=_MEMBER[:7])

    dealt = rows.select(*_MEMBER).repartition(*_GROUP[:3]).sortWithinPartitions(*_GROUP)
    return dealt.mapInArrow(task, "bucket bigint, lo int, hi int, band int, block int, comp bigint, c bigint")


def _confirmed(rows: DataFrame, threshold: int) -> DataFrame:
    """Links among the suspects, by their full sets."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in runs(batches, 4):
            sets = [np.frombuffer(r[9], _U) for r in group]
            yield _links([(group[i][6], group[j][6]) for i, j in _compared(group, threshold) if similar(sets[i], sets[j], threshold)])

    dealt = rows.select(*_MEMBER, "shingles").repartition(*_GROUP[:3]).sortWithinPartitions(*_GROUP)
    return dealt.mapInArrow(task, "a bigint, b bigint")


def _local_forests(edges: DataFrame) -> DataFrame:
    """Union-find inside each partition: every node's edge to the least node it reaches there."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            top = x
            while parent.setdefault(top, top) != top:
                top = parent[top]
            while parent[x] != top:
                parent[x], x = top, parent[x]
            return top

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = root(a), root(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        yield _links([(x, root(x)) for x in list(parent) if root(x) != x])

    return edges.select("a", "b").mapInArrow(task, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """c, root: the least node reachable from each node that has an edge and is not least itself.

    Rounds of local union-find and of star contraction: every node is tied to the least
    neighbour, first by its larger, then by its smaller neighbours. It ends when all edges lead
    to roots, after a number of rounds that grows with the logarithm of the longest path.
    """
    pairs = stage(_local_forests(edges.where("a != b")), "forest")
    while True:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        larger = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        up = larger.where("a != b").distinct()
        tops = up.groupBy("a").agg(F.min("b").alias("m"))
        down = up.join(tops, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"),
                                         F.col("m").alias("b")).where("a != b").distinct()
        pairs = stage(_local_forests(down), "forest")
        # stars only: one edge a node, and no root below another
        crossing = pairs.select(F.col("b").alias("a")).distinct().join(pairs, "a", "left_semi")
        double = pairs.groupBy("a").count().where("count > 1").select("a")
        if crossing.unionByName(double).isEmpty():
            return pairs.select(F.col("a").alias("c"), F.col("b").alias("root"))


def _texts_of_one_id(filled: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between the classes of ids that have rows with different sets."""
    several = filled.groupBy("id").agg(F.min("set_id").alias("lo"), F.max("set_id").alias("hi")).where("lo != hi")
    held = filled.select("id", "set_id").join(several.select("id"), "id").join(classes.select("set_id", "c"), "set_id").select("id", "c")
    return held.join(held.groupBy("id").agg(F.min("c").alias("b")), "id").where("c != b").select(F.col("c").alias("a"), "b")


def _components_of_sets(docs: DataFrame, id_col: str, text_col: str, threshold: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Signed rows, classes of equal sets, and the root of each class that is not its own; all written."""
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    signed = stage(_signed(source), "signatures")
    filled = signed.where("n_shingles > 0 and id is not null")
    classes = stage(filled.groupBy("set_id").agg(
        F.min("id").cast("bigint").alias("c"), F.any_value("n_shingles").alias("n"), F.any_value("sig").alias("sig")), "classes")

    keys = F.array(*[F.struct(F.lit(b).alias("band"), F.xxhash64(F.lit(b), F.substring("sig", ROWS * b + 1, ROWS)).alias("bucket"))
                     for b in range(BANDS)])
    banded = classes.select("c", F.explode(keys).alias("k")).select("c", "k.band", "k.bucket")
    shared = stage(banded.groupBy("bucket").agg(F.min("c").alias("pivot"), F.count(F.lit(1)).alias("size")).where("size > 1"), "buckets")
    members = stage(banded.join(shared, "bucket"), "members")
    meeting = stage(members.select("c").distinct(), "meeting")
    sets = stage(_with_sets(source.join(meeting, F.col("id") == F.col("c")).select("id", "text")), "sets")

    pairs = stage(members.where("c != pivot").groupBy("c", "pivot").agg(F.max("size").alias("size")), "pairs")
    links = stage(_centre_links(pairs, sets, threshold).unionByName(_texts_of_one_id(filled, classes)), "links")
    found = components(links)

    labelled = stage(members.drop("pivot", "size").join(found, "c", "left").withColumn("comp", F.coalesce("root", "c")).drop("root"), "labelled")
    mixed = labelled.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("size"))
    open_members = labelled.join(mixed.where("lo != hi").select("bucket", "size"), "bucket")
    dealt = stage(_block_pairs(open_members).drop("size"), "blocks")
    suspects = stage(_suspects(dealt.join(sets.drop("shingles"), "c"), threshold), "suspects")
    more = stage(_confirmed(suspects.join(sets, "c"), threshold), "links")
    found = components(links.unionByName(more))
    return signed, classes, found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """id, n_shingles, component_id, kept of every document.

    ``component_id`` is the least id reachable over links; null for a null id, which is always kept.
    """
    with small_batches(docs.sparkSession):
        signed, classes, found = _components_of_sets(docs, id_col, text_col, threshold)
    rooted = classes.select("set_id", "c").join(found, "c", "left").select("set_id", F.coalesce("root", "c").alias("_root"))
    joined = signed.drop("sig").join(rooted, "set_id", "left")
    kind = docs.schema[id_col].dataType
    component = F.when(F.col("id").isNull(), F.lit(None)).when(F.col("n_shingles") == 0, F.col("id")).otherwise(
        F.col("_root")).cast(kind)
    return joined.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def without_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       threshold: int = STAGE_THRESHOLD) -> DataFrame:
    """``docs`` without the documents that are not the first of their component, and without repeated rows.

    The ids to be left out are written first, so Spark knows how many there are when it chooses
    the join. Of rows that repeat an id one is kept: the one of least text among those with words,
    if there are any. Rows without an id stay.
    """
    rows, names = by_position(docs)
    id_name, text = name_of(names, id_col), F.col(name_of(names, text_col))
    found = stage(near_duplicates(docs, id_col, text_col, threshold).select(F.col(f"`{id_col}`").alias("id"), "kept"), "components")
    gone = stage(found.where("not kept").select("id").distinct(), "gone")
    again = stage(found.where("id is not null").groupBy("id").count().where("count > 1").select("id"), "again")
    same = lambda ids: F.col(id_name) == ids["id"]
    kept = rows.join(gone, same(gone), "left_anti")
    columns = [F.col(n) for n in names]
    order = F.struct(~F.coalesce(text.rlike(_WORD.pattern), F.lit(False)), text.isNull(), text, F.xxhash64(*columns))
    once = kept.join(again, same(again), "left_semi").groupBy(id_name).agg(F.min_by(F.struct(*columns), order).alias("row")).select("row.*")
    single = kept.join(again, same(again), "left_anti").unionByName(once)
    return single.select(*[F.col(n).alias(c) for n, c in names.items()])
