"""A corpus pipeline: filter, de-duplicate, redact, mix and tokenise ``documents``.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; all but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from fenestra.llm import bpe, poisson_mix, quality_rules, randomness, superminhash
from fenestra.llm.common import table
from fenestra.session import stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current rule policy keeps."""
    return quality_rules.good_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest id.

    Of rows that repeat that id one is kept. Documents without words or without an id have no
    duplicates and stay.
    """
    return superminhash.without_duplicates(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts masked; ``n_chars`` follows the new text."""
    return randomness.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the target weights of their sources, in a global random order."""
    return poisson_mix.mix(docs).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document of the mix."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.digests(docs, ["doc_id", "source"], path, public_tokenizers.PATTERN)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality), ("minhash_near_dedup", near_duplicates), ("secret_scan", secrets),
    ("poisson_mix", mixed), ("byte_bpe", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Not expressible in SQL: byte-pair merging and min-wise signatures; tests/llm holds the stages against brute force.
ORACLE_SQL = None
