"""What a run leaves behind: units, a log line per page, and the raw answers, written together."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fenestra.operators.responses import anchor_units, read_units
from fenestra.streaming.commits import read_committed, write_together

_PAGE = ["doc_id", "page_no"]


def run_tables(responses: DataFrame) -> dict[str, DataFrame]:
    """``units``, ``log`` and ``raw`` of a batch of responses (doc_id, page_no, raw_text, error, ...).

    Every page has a log line, with the error of a failed call or the length of its answer; failed calls have
    neither raw text nor units.
    """
    answered = responses.where(F.col("error").isNull())
    extra = [c for c in ("elapsed", "in_tok", "out_tok") if c in responses.columns]
    return {
        "units": anchor_units(read_units(answered)).drop("error"),
        "log": responses.select(*_PAGE, *extra, "error", F.coalesce(F.length("raw_text"), F.lit(0)).alias("raw_len")),
        "raw": answered.select(*_PAGE, "raw_text")}


def record_run(root: str):
    """``foreachBatch`` function: the three tables of a batch of responses appear at once, and once only."""
    return write_together(root, run_tables)


def run_table(spark, root: str, name: str) -> DataFrame | None:
    """``units``, ``log`` or ``raw`` of all committed batches."""
    return read_committed(spark, root, name)
