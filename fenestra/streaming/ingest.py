"""Incremental ingestion with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.types import StructType

from fenestra.streaming.incremental import read_or_empty

# fixed schema of the binary file source
BINARY_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def watch_files(spark: SparkSession, path: str, pattern: str = "*", max_files: int | None = None) -> DataFrame:
    """Stream of new files as (name, size, mtime); the content is not read."""
    reader = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("pathGlobFilter", pattern)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "path",
                                    F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


def watch_table(spark: SparkSession, path: str, schema: StructType | str, fmt: str = "json",
                pattern: str = "*", max_files: int | None = None) -> DataFrame:
    """Stream over a drop folder of JSON or Parquet files."""
    reader = spark.readStream.format(fmt).schema(schema).option("pathGlobFilter", pattern)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


#: Fixed fields of a chat message file, one JSON object per line.
CHAT_MESSAGE = ("struct<`from`:struct<id:bigint>,chat:struct<id:bigint>,"
                "document:struct<file_id:string,file_name:string,file_size:bigint>>")
CHAT_UPDATE = f"update_id bigint, message {CHAT_MESSAGE}, channel_post {CHAT_MESSAGE}"


def chat_files(updates: DataFrame, chat_id: int, offset: int | None = None) -> DataFrame:
    """Attachments of one sender or chat as (update_id, file_id, name, size), from a stream or table of ``CHAT_UPDATE``.

    Messages of others and messages without an attachment are left out; a file without a name is named by its id. With
    ``offset``, messages of smaller numbers have been seen.
    """
    said = F.coalesce("message", "channel_post")
    ours = F.coalesce(said["from"]["id"] == chat_id, F.lit(False)) | F.coalesce(said["chat"]["id"] == chat_id, F.lit(False))
    new = F.lit(True) if offset is None else F.col("update_id") >= offset
    file = said["document"]
    name = F.coalesce(file["file_name"], F.concat(F.lit("file_"), F.substring(file["file_id"], 1, 8), F.lit(".bin")))
    return updates.where(ours & new & file.isNotNull()).select(
        "update_id", file["file_id"].alias("file_id"), name.alias("name"), F.coalesce(file["file_size"], F.lit(0)).alias("size"))


def next_offset(updates: DataFrame) -> int | None:
    """Number of the first message that has not been seen, whoever sent the others; None without messages."""
    last = updates.agg(F.max("update_id")).first()[0]
    return None if last is None else last + 1


def drop_repeats(stream: DataFrame, keys: list[str], time: str, lateness: str) -> DataFrame:
    """One row per key among those less than ``lateness`` apart.

    State holds the keys of that period only; choose it longer than the lag of
    the producers, or late repeats pass.
    """
    return stream.withWatermark(time, lateness).dropDuplicatesWithinWatermark(keys)


def run_once(stream: DataFrame, sink: str, checkpoint: str, partition_by: list[str] | None = None) -> StreamingQuery:
    """Process what has arrived since the last run and stop.

    The checkpoint is the offset: a second run over the same folder adds nothing.
    """
    writer = stream.writeStream.format("parquet").option("path", sink).option(
        "checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    query = writer.start()
    query.awaitTermination()
    return query


def for_each_batch(stream: DataFrame, checkpoint: str, fn: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Apply ``fn(batch, batch_id)`` to everything that has arrived, then stop."""
    query = stream.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start()
    query.awaitTermination()
    return query


def append_new(sink: str, keys: list[str], first: list[str]) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function: append the rows whose keys the sink does not have yet.

    Of repeated keys in a batch the first by ``first`` stays. The sink itself is the history, so
    nothing is kept in state however far apart repeats are, and a batch that is run again adds nothing.
    """
    def append(batch: DataFrame, batch_id: int) -> None:
        rest = [c for c in batch.columns if c not in keys]
        once = batch.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*first)).alias("_r")).select(*keys, "_r.*")
        done = read_or_empty(batch.sparkSession, sink, once).select(*[F.col(k).alias(f"_done_{k}") for k in keys])
        same = [F.col(k).eqNullSafe(F.col(f"_done_{k}")) for k in keys]
        once.join(done, same, "left_anti").write.mode("append").parquet(sink)

    return append


PROGRESS = "name string, id string, batch_id bigint, rows_in bigint, rows_per_second double, millis bigint, at string"


def _progress_row(p) -> tuple:
    return (p["name"] or "", str(p["id"]), int(p["batchId"]), int(p["numInputRows"]), float(p["processedRowsPerSecond"]),
            int(p["durationMs"].get("triggerExecution", 0)), p["timestamp"])


def progress_rows(spark: SparkSession, query: StreamingQuery) -> DataFrame:
    """Recent progress of a query as a table."""
    return spark.createDataFrame([_progress_row(p) for p in query.recentProgress], PROGRESS)


class StatusTable(StreamingQueryListener):
    """Appends a row to a table whenever a streaming query has finished a batch, while it runs.

    Add it with ``spark.streams.addListener``; readers see what all listeners of the table have written so far.
    """

    def __init__(self, path: str):
        self.path = path

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        row = (p.name or "", str(p.id), p.batchId, p.numInputRows, float(p.processedRowsPerSecond), p.durationMs.get("triggerExecution", 0), p.timestamp)
        SparkSession.active().createDataFrame([row], PROGRESS).coalesce(1).write.mode("append").parquet(self.path)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
