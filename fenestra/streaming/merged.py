"""Tables that batches are merged into, dealt in buckets by a hash of the key.

``merge_batch`` keeps the newest row per key and merges on read: a batch writes its own rows only, as a delta of each bucket it touches.
Readers take the newest row per key over a bucket's base and deltas. A bucket is rewritten when its deltas exceed a share of
its base, and its deltas alone are merged when there are many, so what a batch writes follows the batch, not the table.

``append_new_indexed`` keeps the first row per key for good: every file of a bucket has a Bloom filter of its keys, a table made
by an aggregate, and a batch reads only those files that may hold one of its keys.

The number of buckets doubles with the size of the table. Files written before stay as they are until their bucket is rewritten: a bucket of
a smaller number holds the rows of several later ones.

Both are lists of files in manifests (``commits``): the last one names all that count, and the
files that it has dropped stay until the next batch for readers of the one before.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from fenestra.operators.leaderboard import KEYS, latest_wins
from fenestra.session import stage
from fenestra.streaming import commits

#: Buckets of a new table, and bytes per bucket at which their number doubles.
BUCKETS, BUCKET_BYTES = 64, 256 << 20
#: Deltas are merged into the base beyond this share of its size, and with each other beyond this number.
SHARE, MOST_FILES = 0.5, 8
#: Keys per 64-bit word of a filter, about; a key sets bits in two words, so one in some thousand others seems to be there.
KEYS_PER_WORD = 4

File = dict[str, Any]  # path, bucket, of (number of buckets), bytes, base
_BUCKET = "_bucket"


def _bucket(keys: list[str], of: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(2), *keys), F.lit(of)).cast("int")


def _write(rows: DataFrame, root: str, name: str, keys: list[str], of: int, base: bool) -> list[File]:
    """Write rows by bucket, one file each; returns the files."""
    spark = rows.sparkSession
    rows.withColumn(_BUCKET, _bucket(keys, of)).repartition(_BUCKET).write.partitionBy(_BUCKET).parquet(f"{root}/{name}")
    found = [n for n in commits.names_in(spark, f"{root}/{name}") if n.startswith(f"{_BUCKET}=")]
    return [{"path": f"{name}/{n}", "bucket": int(n.split("=")[1]), "of": of, "bytes": commits.bytes_in(spark, f"{root}/{name}/{n}"),
             "base": base} for n in found]


def _read(spark: SparkSession, root: str, files: list[File], schema: str) -> DataFrame:
    kind = StructType.fromJson(json.loads(schema))
    if not files:
        return spark.createDataFrame([], kind)
    return spark.read.schema(kind).option("recursiveFileLookup", "true").parquet(*[f"{root}/{f['path']}" for f in files])


def _joint_schema(before: str | None, rows: DataFrame) -> str:
    """The columns of the table and then the new ones of a batch."""
    kind = StructType.fromJson(json.loads(before)) if before else StructType()
    return StructType([*kind.fields, *[f for f in rows.schema.fields if f.name not in kind.names]]).json()


def units(files: list[File]) -> list[list[File]]:
    """Files that may hold rows of the same key: those of a bucket, and of the later buckets that it was split into."""
    found: dict[tuple[int, int], list[File]] = {}
    counts: list[int] = []
    for f in sorted(files, key=lambda f: (f["of"], not f["base"])):
        home = next(((n, f["bucket"] % n) for n in counts if (n, f["bucket"] % n) in found), (f["of"], f["bucket"]))
        if f["of"] not in counts:
            counts.append(f["of"])
        found.setdefault(home, []).append(f)
    return list(found.values())


def due(own: list[File]) -> tuple[list[File], bool]:
    """The files of a unit to be rewritten now, and whether they make a base."""
    base = sum(f["bytes"] for f in own if f["base"])
    deltas = [f for f in own if not f["base"]]
    if sum(f["bytes"] for f in deltas) > SHARE * base:
        return own, True
    return (deltas, False) if len(deltas) > MOST_FILES else ([], False)


def _doubled(of: int, files: list[File]) -> int:
    while sum(f["bytes"] for f in files) > of * BUCKET_BYTES:
        of *= 2
    return of


def _paths(files: list[File]) -> set[str]:
    """Folders of files and of their filters."""
    return {f[k] for f in files for k in ("path", "filter") if k in f}


def _finish(spark: SparkSession, root: str, batch_id: int, before: dict, now: dict, made: list[File]) -> None:
    """Publish, then delete what the commit before had dropped already, and what this batch made and merged again."""
    kept = _paths(now["files"])
    now["dropped"] = sorted(_paths(before["files"]) - kept)
    commits.publish(spark, root, batch_id, now)
    for path in [*before.get("dropped", ()), *(_paths(made) - kept)]:
        commits.remove(spark, f"{root}/{path}")


def merge_batch(root: str, recency: list[str], keys: list[str] | None = None, buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function: keep the newest row per key over all batches, merging on read."""
    keys = keys or KEYS

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if batch_id in commits.versions(spark, root):
            return
        before = commits.latest(spark, root) or {"buckets": buckets, "files": [], "schema": None}
        of, schema = before["buckets"], _joint_schema(before["schema"], batch)
        new = _write(latest_wins(batch, recency, keys), root, commits.attempt("delta", batch_id), keys, of, False)
        files, all_made = before["files"] + new, list(new)
        rewrite: dict[bool, list[File]] = {True: [], False: []}
        for own in units(files):
            if len(own) == 1:
                own[0]["base"] = True  # nothing to merge: the delta is the base
                continue
            chosen, base = due(own)
            rewrite[base] += chosen
        of = _doubled(of, files)
        for base, chosen in rewrite.items():
            if chosen:
                rows = latest_wins(_read(spark, root, chosen, schema), recency, keys)
                made = _write(rows, root, commits.attempt("base" if base else "deltas", batch_id), keys, of, base)
                gone = {f["path"] for f in chosen}
                files = [f for f in files if f["path"] not in gone] + made
                all_made += made
        _finish(spark, root, batch_id, before, {"buckets": of, "files": files, "schema": schema, "keys": keys, "recency": recency,
                                                "bytes_written": sum(f["bytes"] for f in all_made)}, all_made)

    return merge


def read_current(spark: SparkSession, root: str) -> DataFrame | None:
    """The merged rows; None before the first batch. Only buckets with deltas are merged."""
    now = commits.latest(spark, root)
    if now is None:
        return None
    alone = [own[0] for own in units(now["files"]) if len(own) == 1]
    open_files = [f for own in units(now["files"]) if len(own) > 1 for f in own]
    done = _read(spark, root, alone, now["schema"])
    if not open_files:
        return done
    return done.unionByName(latest_wins(_read(spark, root, open_files, now["schema"]), now["recency"], now["keys"]))


def _marks(keys: list[str], words: Column) -> Column:
    """The two words of a filter that a key sets bits in, and the bits: four of 64 each."""
    def one(salt: int) -> Column:
        h = F.xxhash64(F.lit(salt), *keys)
        bits = None
        for k in range(4):
            place = F.shiftrightunsigned(h, 6 * k).bitwiseAND(F.lit(63)).cast("int")
            bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), place)
            bits = bit if bits is None else bits.bitwiseOR(bit)
        return F.struct(F.pmod(F.shiftrightunsigned(h, 24), words).alias("word"), bits.alias("bits"))

    return F.array(one(3), one(4))


def _filters(spark: SparkSession, root: str, files: list[File], schema: str, keys: list[str], name: str) -> None:
    """Write the filter rows (path, words, word, bits) of files, and note in them where they are."""
    listed = spark.createDataFrame([(f["path"], f["bucket"], f["of"]) for f in files], "path string, bucket int, of int")
    rows = _read(spark, root, files, schema).select(_bucket(keys, files[0]["of"]).alias("bucket"), *keys)
    sizes = rows.groupBy("bucket").count().select("bucket", F.greatest(F.lit(1), F.ceil(F.col("count") / KEYS_PER_WORD)).alias("words"))
    of_file = listed.join(sizes, "bucket").select("path", "bucket", "words")
    marks = rows.join(of_file, "bucket").select("path", "words", F.inline(_marks(keys, F.col("words"))))
    marks.groupBy("path", "words", "word").agg(F.bit_or("bits").alias("bits")).write.parquet(f"{root}/{name}")
    words = {r["path"]: r["words"] for r in of_file.collect()}  # one row per file
    for f in files:
        f["filter"], f["words"] = name, words[f["path"]]


def _suspected(spark: SparkSession, root: str, rows: DataFrame, files: list[File], keys: list[str]) -> list[str]:
    """Paths of the files whose filters hold all bits of some key of ``rows``."""
    listed = spark.createDataFrame([(f["path"], f["bucket"], f["of"], f["words"]) for f in files],
                                   "path string, bucket int, of int, words bigint")
    met = None
    for of in sorted({f["of"] for f in files}):
        here = rows.select(*keys).withColumn("bucket", _bucket(keys, of)).join(listed.where(F.col("of") == of), "bucket")
        met = here if met is None else met.unionByName(here)
    asked = met.select("path", F.xxhash64(F.lit(5), *keys).alias("key"), F.inline(_marks(keys, F.col("words"))))
    held = spark.read.parquet(*[f"{root}/{n}" for n in sorted({f["filter"] for f in files})]).withColumnRenamed("bits", "held")
    hits = asked.join(held.select("path", "word", "held"), ["path", "word"]).where(F.col("held").bitwiseAND(F.col("bits")) == F.col("bits"))
    both = hits.groupBy("path", "key").count().where("count >= 2")
    return [r["path"] for r in both.select("path").distinct().collect()]  # at most the files of the sink


def append_new_indexed(sink: str, keys: list[str], first: list[str], buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function: append the rows whose keys the sink does not have yet.

    Of repeated keys in a batch the first by ``first`` stays; null keys are keys like others.
    """
    def append(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if batch_id in commits.versions(spark, sink):
            return
        before = commits.latest(spark, sink) or {"buckets": buckets, "files": [], "schema": None}
        of, schema, files = before["buckets"], _joint_schema(before["schema"], batch), before["files"]
        rest = [c for c in batch.columns if c not in keys]
        once = stage(batch.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*first)).alias("_r")).select(*keys, "_r.*"), "batch")
        read = set(_suspected(spark, sink, once, files, keys)) if files else set()
        new = once
        if read:
            held = _read(spark, sink, [f for f in files if f["path"] in read], schema).select(*[F.col(k).alias(f"_held_{k}") for k in keys])
            new = once.join(held, [F.col(k).eqNullSafe(F.col(f"_held_{k}")) for k in keys], "left_anti")
        added = _write(new, sink, commits.attempt("batch", batch_id), keys, of, False)
        of = _doubled(of, files + added)
        full = [f for own in units(files + added) if len(own) > MOST_FILES for f in own]
        files = [f for f in files + added if f not in full]
        if full:
            files += _write(_read(spark, sink, full, schema), sink, commits.attempt("joined", batch_id), keys, of, True)
        fresh = [f for f in files if "filter" not in f]
        for count in sorted({f["of"] for f in fresh}):
            own = [f for f in fresh if f["of"] == count]
            for folder in sorted({f["path"].split("/")[0] for f in own}):
                _filters(spark, sink, [f for f in own if f["path"].startswith(f"{folder}/")], schema, keys, commits.attempt("filter", batch_id))
        _finish(spark, sink, batch_id, before, {"buckets": of, "files": files, "schema": schema, "files_read": len(read)}, added)

    return append


def read_indexed(spark: SparkSession, sink: str) -> DataFrame | None:
    """All rows of an indexed sink; None before the first batch."""
    now = commits.latest(spark, sink)
    return None if now is None else _read(spark, sink, now["files"], now["schema"])
