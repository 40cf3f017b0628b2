"""Commits: what a batch writes becomes visible at once, however many tables it writes to.

Every attempt at a batch writes folders of its own. A batch counts when its manifest, one small JSON file per batch number,
is there; it is renamed into place. Readers follow manifests only, so the folders of an attempt that was killed are never
read, and a batch that is run again finds its manifest and does nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

_FOLDER = "commits"


def _located(spark: SparkSession, path: str):
    """(file system, path) of a path in any store that Spark can write to."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none if it does not exist."""
    fs, folder = _located(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []


def bytes_in(spark: SparkSession, path: str) -> int:
    fs, folder = _located(spark, path)
    return fs.getContentSummary(folder).getLength()


def remove(spark: SparkSession, path: str) -> None:
    fs, folder = _located(spark, path)
    fs.delete(folder, True)


def attempt(label: str, batch_id: int) -> str:
    """Folder name of one attempt at a batch."""
    return f"{label}-{batch_id:012d}-{uuid.uuid4().hex}"


def versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the committed batches, ascending."""
    return [int(n.removesuffix(".json")) for n in names_in(spark, f"{root}/{_FOLDER}") if n.endswith(".json")]


def publish(spark: SparkSession, root: str, batch_id: int, manifest: dict[str, Any]) -> None:
    """Make a batch count."""
    fs, draft = _located(spark, f"{root}/{_FOLDER}/.{uuid.uuid4().hex}")
    out = fs.create(draft)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    if not fs.rename(draft, _located(spark, f"{root}/{_FOLDER}/{batch_id:012d}.json")[1]):
        fs.delete(draft, True)
        raise RuntimeError(f"batch {batch_id} was committed by somebody else")


def manifest(spark: SparkSession, root: str, batch_id: int) -> dict[str, Any]:
    return json.loads(spark.read.text(f"{root}/{_FOLDER}/{batch_id:012d}.json", wholetext=True).first()[0])


def latest(spark: SparkSession, root: str) -> dict[str, Any] | None:
    """The manifest of the last committed batch."""
    done = versions(spark, root)
    return manifest(spark, root, done[-1]) if done else None


def write_together(root: str, tables: Callable[[DataFrame], dict[str, DataFrame]]) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function: append the named tables made from a batch, all of them or none.

    After the commit, folders of earlier attempts at the same batch are deleted.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if batch_id in versions(spark, root):
            return
        paths = {}
        for name, rows in tables(batch).items():
            paths[name] = attempt("batch", batch_id)
            rows.write.parquet(f"{root}/{name}/{paths[name]}")
        publish(spark, root, batch_id, {"batch": batch_id, "tables": paths})
        for name, own in paths.items():
            for other in names_in(spark, f"{root}/{name}"):
                if other.startswith(f"batch-{batch_id:012d}-") and other != own:
                    remove(spark, f"{root}/{name}/{other}")

    return write


def read_committed(spark: SparkSession, root: str, table: str) -> DataFrame | None:
    """All committed rows of a table; None before the first batch."""
    try:
        done = spark.read.schema("batch bigint, tables map<string,string>").json(f"{root}/{_FOLDER}/*.json")
    except AnalysisException:
        return None
    found = [r[0] for r in done.select(done["tables"][table]).collect() if r[0]]  # one name per batch
    return spark.read.parquet(*[f"{root}/{table}/{name}" for name in sorted(found)]) if found else None
